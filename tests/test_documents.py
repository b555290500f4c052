"""Word files, pages that begin at headings, and the library's functions in SQL."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tideline.functions import learning as L
from tideline.functions import sql as Q
from tideline.functions import structure as X
from tideline.functions import text as T
from tideline.functions import turns
from tideline.operators import relational
from tideline.sources import docx

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def word_file(parts, styles=True):
    """A document of (style id or None, text) paragraphs, with a table that is no paragraph of the body."""
    made = "".join(f"<w:p>{f'<w:pPr><w:pStyle w:val=\"{s}\"/></w:pPr>' if s else ''}<w:r><w:t>{t}</w:t></w:r></w:p>" for s, t in parts)
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{made}<w:tbl><w:tr><w:tc><w:p><w:r><w:t>in a table</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
        if styles:
            z.writestr("word/styles.xml", f'<w:styles {W}><w:style w:styleId="T1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="N"><w:name w:val="Normal"/></w:style><w:style w:styleId="X"/></w:styles>')
    return book.getvalue()


FILES = {
    "a.docx": word_file([("N", "before any heading"), ("T1", "Rivers"), (None, "one"), (None, "  "), ("N", "two</w:t><w:tab/><w:t>more"), ("T1", "Empty one"), (None, "Chapter 2 of it"), ("X", "three")]),
    "b/c.docx": word_file([("Heading1", "Only"), ("Heading2", "headings")], styles=False),
    "b/plain.docx": word_file([(None, "no heading"), (None, "at all")], styles=False),
    "b/none.docx": word_file([]),
    "broken.docx": b"this is no zip file",
    "other.txt": b"not a document",
}


@pytest.fixture
def folder(tmp_path):
    for name, content in FILES.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    return tmp_path


def name_of(path, folder):
    return path.split(f"{folder}/")[-1]


def test_word_files_as_binary_files_and_as_a_source(spark, folder):
    docx.register_docx(spark)
    by_tasks = docx.docx_paragraphs(spark, str(folder))
    source = spark.read.format("docx").load(str(folder))
    told = lambda f: sorted((name_of(r.path, folder), r.paragraph, r.style, r.heading, r.text) for r in f.collect())
    assert told(by_tasks) == told(source) and by_tasks.schema == source.schema
    assert source.rdd.getNumPartitions() == 5
    rows = [r for r in told(source) if r[0] == "a.docx"]
    assert [r[2:] for r in rows] == [("Normal", False, "before any heading"), ("heading 1", True, "Rivers"), ("", False, "one"), ("Normal", False, "two\tmore"), ("heading 1", True, "Empty one"), ("", True, "Chapter 2 of it"), ("X", False, "three")]
    assert told(spark.read.format("docx").load(str(folder / "b" / "*.docx"))) == [r for r in told(source) if r[0].startswith("b/")]


def test_pages_of_word_files(spark, folder):
    pages = docx.logical_pages(docx.docx_paragraphs(spark, str(folder)), "path", "paragraph").collect()
    assert sorted((name_of(r.path, folder), r.page, r.section, r.text) for r in pages) == [
        ("a.docx", 0, None, "before any heading"),
        ("a.docx", 1, "Rivers", "one\n\ntwo\tmore"),
        ("a.docx", 2, "Chapter 2 of it", "three"),
        ("b/c.docx", 0, None, "Only\n\nheadings"),
        ("b/plain.docx", 0, None, "no heading\n\nat all"),
    ]


def test_pages_of_headings_alone_and_of_nothing(spark):
    lines = spark.createDataFrame([(1, 0, True, "A"), (1, 1, True, "B"), (2, 0, True, None), (None, 0, False, "x")], "k int, i int, heading boolean, text string")
    assert sorted((r.k or 0, r.page, r.section, r.text) for r in docx.logical_pages(lines, "k", "i").collect()) == [(0, 0, None, "x"), (1, 0, None, "A\n\nB")]
    assert docx.logical_pages(lines.where("false"), "k", "i").count() == 0


def test_names_in_sql_mean_what_the_functions_mean(spark):
    assert Q.register(spark) == Q.register(spark) and "slug" in Q.register(spark)
    texts = [None, "", "Water Cycle!", "__x__", "a" * 900, "é ö", "Size 4"]
    frame = spark.createDataFrame([(i, t, i / 5) for i, t in enumerate(texts)], "i int, t string, x double")
    frame.createOrReplaceTempView("_named")
    t, x = F.col("t"), F.col("x")
    ours = frame.select("i", T.slug(t), T.token_length(t), L.clamp01(x), L.risk_level(x), F.sha2(F.concat_ws(":", F.coalesce(t, F.lit("")), F.lit("b")), 256)).orderBy("i").collect()
    named = spark.sql("SELECT i, slug(t), token_length(t), clamp01(x), risk_level(x), row_digest(t, 'b') FROM _named ORDER BY i").collect()
    assert [tuple(r) for r in ours] == [tuple(r) for r in named]
    assert spark.sql("SELECT mastery_step(0.95, 0.15), health_status(69.9), health_status(70)").first()[:] == (1.0, "Fair", "Good")


def test_functions_of_tables_in_sql(spark):
    Q.register(spark)
    cells = spark.sql("SELECT line, place, value FROM markdown_cells('x\n| a | b |\n|---|:-:|\n| 1 |  |\n') ORDER BY line, place").collect()
    assert [tuple(r) for r in cells] == [(0, 0, "a"), (0, 1, "b"), (1, 0, "1"), (1, 1, "")]
    assert spark.sql("SELECT * FROM split_text(CAST(NULL AS STRING), 8, 1)").count() == 0 and spark.sql("SELECT * FROM markdown_cells('')").count() == 0


def test_the_splitter_in_sql_gives_the_chunks(spark):
    from tideline import catalog

    sf = "/root/testdata/sf0.001"
    told = lambda name: sorted((r.doc_id, r.ordinal, r.text, r.n_chars) for r in catalog.QUERIES[name](spark, sf).collect())
    assert told("sql_chunks") == told("doc_chunks")


def test_numerals_counts_and_titles(spark):
    frame = spark.createDataFrame([("xiv",), ("MCMXCIV",), ("chapter",), ("ix",), ("",), (None,)], "t string")
    assert [r.x for r in frame.select(X.roman(F.col("t")).alias("x")).collect()] == [14, 1994, None, 9, None, None]
    said = spark.createDataFrame([("Explain it in 3 sentences",), ("give me TWO points",), ("12 lines",), ("many points",), ("Why is the sky blue?",), ("You are repeating yourself",), ("ç ç ç",)], "q string")
    q = F.col("q")
    got = said.select(turns.requested_count(q).alias("n"), turns.is_complaint(q).alias("c"), turns.is_non_answer(q).alias("a"), turns.answer_type(q).alias("k"), X.breadth(q).alias("b")).collect()
    assert [r.n for r in got] == [3, 2, 10, None, None, None, None] and [r.c for r in got] == [False] * 5 + [True, False] and [r.a for r in got] == [False] * 4 + [True, True, False]
    assert [r.k for r in got][1] == "bullet-points" and {r.b for r in got} == {"narrow"}
    titles = spark.createDataFrame([("Chapter 3.  The   rivers ...... 41",), ("2.1) Rain 7",), ("Year 2024",), ("plain",)], "t string")
    assert [r.x for r in titles.select(turns.clean_title(F.col("t")).alias("x")).collect()] == ["The rivers", "Rain", "Year", "plain"]


@pytest.mark.parametrize("most", [0, 100])
def test_top_terms_are_those_of_a_plain_count(spark, most):
    rng = random.Random(5)
    rows = [(rng.choice(["en", "de", None]), [rng.choice("aabbcdefghij") * 4 for _ in range(rng.randint(0, 12))]) for _ in range(60)] + [("en", None)]
    counts = {}
    for lang, words in rows:
        for term in (words or []) + [f"{a} {b}" for a, b in zip(words or [], (words or [])[1:], strict=False)]:
            counts[lang, term] = counts.get((lang, term), 0) + 1
    want = set()
    for lang in ("en", "de", None):
        own = sorted(((t, n) for (k, t), n in counts.items() if k == lang), key=lambda x: (-x[1], x[0]))
        want |= {(lang, t, n, i + 1) for i, (t, n) in enumerate(own[:6])}
    frame = spark.createDataFrame(rows, "lang string, w array<string>")
    assert {tuple(r) for r in relational.top_terms(frame, ["lang"], "w", 6, most).select("lang", "term", "n", "rank").collect()} == want


def test_the_level_is_found_once_for_the_difficulty(spark):
    texts = spark.createDataFrame([("compare a and b",)], "t string").select(T.difficulty(T.bloom(F.col("t")), F.lit(4), digits=4).alias("x"))
    assert texts._jdf.queryExecution().analyzed().toString().count("regexp_extract_all") == 1
    assert texts.first().x == 3.684
