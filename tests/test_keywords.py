"""Keywords are ranked in the row of their text, rows that share an id are counted together, and captions are told by their
beginning as by the whole."""

import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.compare import differences, duck
from tests.test_scale import rows_made
from tideline import catalog
from tideline.functions import dialogue as D
from tideline.plans import dialogue

NAME = "semantic_keywords"


def stored(folder, rows):
    pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}).to_parquet(folder / "documents.parquet")
    return str(folder)


def against_sql(spark, sf):
    con = duck("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    return differences(spark, con, catalog.QUERIES[NAME], catalog.ORACLE_SQL[NAME], sf)


def texts(n):
    rng = random.Random(4)
    words = ["rain", "monsoon", "map", "river", "the", "and", "cell", "Élan", "élanrain", "x9", "snow_fall", "gravity", "photosynthesis", "MAP", "light-house", "ab", "stone", "sand dune", "temple"]
    return [" ".join(rng.choice(words) + rng.choice(["", ".", ",", "\n"]) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_no_more_rows_than_documents(spark, tmp_path):
    sf = stored(tmp_path, list(enumerate(texts(200))))
    assert against_sql(spark, sf) == ""
    ranked = catalog.QUERIES[NAME](spark, sf)
    assert ranked.collect() and rows_made(ranked) <= 200 and "Exchange" not in ranked._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("few", [200_000, 1])
def test_rows_that_share_an_id_are_counted_together(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(dialogue, "FEW", few)
    rows = [(i % 90, t) for i, t in enumerate(texts(120))] + [(None, "rain rain"), (None, "rain"), (200, None), (200, "snow"), (201, None), (202, "the of"), (203, "a map of")]
    assert against_sql(spark, stored(tmp_path, rows)) == ""


def whole_caption(text):
    number = r"^fig\.?\s*[0-9]+(?:\.[0-9]+)*\s*"
    raw = text.lower().strip(D.BLANKS)
    t = re.sub(r"\s+", " ", re.sub(number + "[:. ]+", "", raw, flags=re.A), flags=re.A).strip(" .:;-")
    return "" if re.search(number + r"\.?\Z", raw, re.A) or re.search(r"^[0-9. ]+\Z", t) else t[:512]


def test_captions_by_their_beginning(spark):
    digits, words = "12. " * 700, "rain on hills " * 300
    said = [words, "Fig. 2.3: " + words, "fig " + "1" * 3000 + ": map", "fig.1." + "1" * 3000 + ": map", "fig 7", digits, digits + "map", "map " + digits, "a" * 511, "a" * 512, "a" * 513]
    said += ["a" * 511 + " " * 3000 + "map", "a" * 512 + " " * 3000 + "map", " " * 3000 + "map" + " " * 3000, "a" + "\n" * 2046 + "map " * 400, "x " + ". ;" * 900, "x " + ". ;" * 900 + "map", "--" + words, "." * 2100 + "map", "é" * 600, "a" * 511 + "-" * 3000, "a" * 511 + "-" * 3000 + "b"]
    frame = spark.createDataFrame(list(enumerate(said)), "i int, t string")
    got = [r.x for r in frame.select("i", D.plain_caption(F.col("t")).alias("x")).orderBy("i").collect()]
    assert got == [whole_caption(t) for t in said]


def test_one_pattern_finds_every_figure_type(spark):
    plain = lambda w: w.replace(r"\s+", "  ").replace(r"\s*", " ").replace("s?", "s").replace(".?", "-").replace("['’]", "’").replace("[0-9]", "3")
    own = [plain(w) for r in D.FIGURES for w in D.words_of(r.pattern)]
    assert len(own) > 150 and not any(set(w) & set(r"\[(?|*+") for w in own)
    said = [f"{a}{w}{b}" for w in own for a, b in [("", ""), ("on ", "."), ("é", ""), ("", "é"), ("_", ""), ("", "9"), ("—", "—"), ("rain\n", "\nx")]]
    one_of = [F.col("t").rlike(r.pattern) for r in D.FIGURES]
    frame = spark.createDataFrame([(t,) for t in said], "t string").select("t", F.greatest(*one_of).alias("a"), F.col("t").rlike(D.ANY_FIGURE).alias("b"))
    assert frame.where("a <> b").collect() == [] and 0 < frame.where("a").count() < len(said)
