import pytest

from tideline.sources.scratch import scratch_path


class _Conf:
    def __init__(self, root):
        self.root = root

    def get(self, key, default=None):
        return self.root if self.root and key == "spark.checkpoint.dir" else default


class _Context:
    applicationId = "app-scratch-test"

    def __init__(self, master):
        self.master, self.dir = master, None

    def setCheckpointDir(self, path):
        self.dir = path


class _Session:
    """What scratch_path reads of a session whose own setting cannot be changed once it runs."""

    def __init__(self, master, root=None):
        self.conf, self.sparkContext = _Conf(root), _Context(master)


def test_configured_folder_is_used():
    assert scratch_path(_Session("spark://host:7077", "/shared/x/"), "t").startswith("/shared/x/tideline/t-")


def test_local_session_gets_one_folder_of_its_own():
    a, b = _Session("local[4]"), _Session("local[4]")
    first, second = scratch_path(a, "t"), scratch_path(b, "t")
    assert first != second and first.rsplit("/", 1)[0] == second.rsplit("/", 1)[0]
    assert a.sparkContext.dir and first.startswith(a.sparkContext.dir)


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"])
def test_cluster_without_a_folder_is_an_error(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_path(_Session(master), "t")
