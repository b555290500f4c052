"""Rules on turns, captions and titles by hand, and the alignment and increasing runs against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tideline.functions import dialogue as D
from tideline.functions import splitting
from tideline.operators import titles
from tideline.operators import windows as W
from tideline.sources import tables


def column_of(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def test_acts_first_rule_wins(spark):
    said = [None, "  ", "Hello, I'm confused", "hello there", "quiz me", "5 questions please", "mcq please", "make it simpler", "recap", "show me the map", "draw it", "an example?", "rain vs snow", "Okay!", "okay then what", "what is light"]
    want = ["none", "none", "clarification", "greeting", "generate_questions", "generate_questions", "generate_mcq", "simplify", "ask_summary", "ask_visual", "ask_diagram", "ask_example", "ask_comparison", "continue_explanation", "new_topic", "new_topic"]
    assert column_of(spark, said, D.dialogue_act) == want


ACTS = {
    "good morning": "greeting", "thank you": "small_talk", "quiz me": "generate_questions", "give me 5 questions": "generate_questions", "mcq please": "generate_mcq", "simplify please": "simplify",
    "explain in simple words": "simplify", "explain like im dumb": "simplify", "keep it simple": "simplify", "i keep forgetting": "clarification", "summarize this": "ask_summary", "show me a diagram": "ask_diagram",
    "show me the figure": "ask_visual", "give a real life example": "ask_example", "compare solids and liquids": "ask_comparison", "yes": "continue_explanation", "go on": "continue_explanation",
    "go deeper on that": "continue_explanation", "i did not understand this": "clarification", "I'm confused": "clarification", "what is photosynthesis": "new_topic", "What are weather instruments": "new_topic",
    "what is your name": "small_talk", "who are you": "small_talk", "what would": "small_talk", "can you tell": "small_talk", "thanks for explaining": "small_talk", "right thanks for explaining": "small_talk",
    "ok thanks": "small_talk", "got it thanks": "small_talk", "no I am not": "continue_explanation", "no I'm not": "continue_explanation", "not really": "continue_explanation", "nope": "continue_explanation",
    "is": "new_topic", "same": "new_topic", "why does soil erode, thanks to rainfall patterns over long periods": "new_topic", "how did you get 5": "continue_explanation",
    "is it option a rain or option b snow": "new_topic", "(a) rain (b) mcq": "new_topic", "a) mcq": "generate_mcq", "true or false: an mcq": "new_topic", "ç ç ç ç ç": "new_topic", "óhi": "new_topic", "\t hello\n": "greeting",
}


def test_acts_of_known_turns(spark):
    assert dict(zip(ACTS, column_of(spark, list(ACTS), D.dialogue_act), strict=True)) == ACTS


def test_affect_and_trajectory(spark):
    said = ["bye, too hard", "too hard", "so hard", "boring", "wow", "Got it!", "yesterday it rained", "why?", "stone", None]
    assert [a.affect for a in column_of(spark, said, D.affect)] == ["closing", "confused", "frustrated", "bored", "excited", "affirmation", "personal", "curious", "neutral", "neutral"]
    more = {"I don't get it, this is too hard": "confused", "this is boring can we do something else": "bored", "wow that's so cool": "excited", "thanks I'm done for today": "closing", "got it": "affirmation", "yesterday it rained near my house": "personal", "sure whatever": "bored", "what is weather": "curious", "yeah right, if you say so": "bored", "tell me more": "curious", "What is weather?": "curious", "is it so?\n": "curious", "curious wonder": "neutral", "Doó you": "neutral", "ç ç ç ç ç": "neutral"}
    assert [a.affect for a in column_of(spark, list(more), D.affect)] == list(more.values())
    sarcasm, whatever, deep, plain = column_of(spark, ["yeah right", "whatever", "i wonder why", "why"], D.affect)
    assert (sarcasm.valence, whatever.valence, deep.valence, plain.valence) == (-0.5, -0.4, 0.4, 0.3)
    runs = [["a", "a", "b"], [], list("abcdefg"), list("aabbaa")]
    assert column_of(spark, runs, D.trajectory, "array<string>") == [["a", "b"], [], list("cdefg"), list("aba")]


@pytest.mark.parametrize("phrase, text, found", [("read map", "reading a map", True), ("weather station", "weather at the bus station", False), ("the river", "rivers", False), ("light", "highlights", True), ("change seasons", "Changed the old season", True)])
def test_phrases_in_any_inflection(spark, phrase, text, found):
    assert column_of(spark, [text, None], lambda c: D.holds_phrase(c, phrase)) == [found, False]


def test_figures_paragraphs_formulas(spark):
    facts = column_of(spark, ["Fig. 2 Map of rivers", "", None, "Students with a barometer", "shows key things"], D.figure_facts)
    assert [(f.type, f.role) for f in facts] == [("map", "supporting_example"), ("unknown", "decorative"), ("unknown", "decorative"), ("instrument", "activity"), ("unknown", "supporting_example")]
    assert facts[1].salience == facts[2].salience == 0.1 and facts[0].salience == pytest.approx(0.3) and facts[4].salience == pytest.approx(16 / 200 + 0.15)
    assert column_of(spark, [" a *b* \n\n c$ ", "中文\nx", None], D.paragraph) == [r"a \*b\* c\$", "中文x", ""]
    assert column_of(spark, ["x + 1 = \\alpha b", "a  b", r"\ 2"], D.latex_compact) == ["x+1=\\alpha b", "a  b", r"\ 2"]


def test_figure_types_by_caption_sight_and_surroundings(spark):
    rows = [("Fig. 2.7. A 19th-century painting of the sultan", "the political map", None, "historical_photo"), ("Fig. 2.2.", "", "type: timeline; subject: events", "chart"), ("Fig. 2.12. Kingdoms in the Deccan", "a map", "type: map; subject: kingdoms", "map"), ("Temple by the lake", None, None, "historical_photo"), ("Fig. 3", "near the river coast", None, "landscape"), ("Rows of old houses", "a map", None, "unknown"), ("A sunflower", None, None, "diagram"), ("Timeline of kings", None, None, "chart"), ("number line", None, None, "diagram"), ("ç ç ç ç ç", None, None, "unknown"), (None, None, None, "unknown")]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, c string, n string, s string, want string")
    got = frame.select("i", D.figure_type(F.col("c"), F.col("n"), F.col("s")).alias("x")).orderBy("i").collect()
    assert [r.x for r in got] == [r[3] for r in rows]


def test_tags_and_keywords(spark):
    frame = spark.createDataFrame([(1, "Parliament and the atom", "diagram", "primary_concept"), (2, None, "unknown", None), (3, "cell force atom map war law bank verb", "weather_station", "activity"), (4, "ç ç atomç", "map", "sidebar_example")], "i int, t string, k string, r string")
    got = {r.i: r.x for r in frame.select("i", D.educational_tags(F.col("t"), F.col("k"), F.col("r")).alias("x")).collect()}
    assert got[1] == "chemistry|history|civics|nuclear_physics|diagram|structure|concept|teaching" and got[2] == "" and got[4] == "map|geography|location|reference"
    assert got[3] == "biology|physics|chemistry|geography|history|civics|economics|english|nuclear_physics|instrument|measurement|meteorology"
    words = F.array(F.lit("rain"), F.lit("map"))
    assert [spark.range(1).select(D.keywords_with_type(words, F.lit(k).cast("string")).alias("x")).first().x for k in ("chart", "map", "unknown", None)] == ["chart|rain|map", "rain|map", "rain|map", "rain|map"]


TORN = {"be co h l l h l l h": True, "ab cd ef gh ij": True, "a b c": True, "rain on a hill": False, "x y rain hill": False, "l e t t e r": True, "ab cd": False, "ç ç ç ç ç": False, None: False, "": False, "a-b-c-d": True}
CORRUPT = {"perating\nweather\nrection": True, "and and the People": True, "Fig. 2.2—be co h l l h l l h Fig.": True, "Reprint 2026-27": True, "Map of the main rivers": False, "Fig. 4": False, "clos\nd the": True, "one line here\nand two\nand three": True, "Fig. 3.1 12 45 78": True, None: False, "": False, "Indian Astronomical Observatory, Hanle": False, "ç ç ç ç ç": False}


def test_torn_and_corrupt_captions(spark):
    assert dict(zip(TORN, column_of(spark, list(TORN), D.letter_spaced), strict=True)) == TORN
    assert dict(zip(CORRUPT, column_of(spark, list(CORRUPT), D.corrupt_caption), strict=True)) == CORRUPT


def test_stems_and_gaps_of_phrases(spark):
    assert [D.stem(w) for w in ("reading", "used", "uses", "shes", "sing", "maps", "es", "tree")] == ["read", "used", "use", "she", "sing", "map", "es", "tre"]
    texts = ["under license", "under an mit license", "under the gnu public license", "license under", "UNDER\nthe  Licensing", "thunder license", "under license license x", "under a b c license under license"]
    assert column_of(spark, texts, lambda c: D.holds_phrase(c, "under license")) == [True, True, False, False, True, True, True, True]
    three = ["red big house", "red x y big x y house", "red x y z big house", "house big red"]
    assert column_of(spark, three, lambda c: D.holds_phrase(c, "red big house")) == [True, True, False, False]


def test_evidence_in_order(spark):
    row = lambda *v: spark.createDataFrame([v], "kind string, correct boolean, confusion double, hint boolean, share double, affirmed boolean, understanding double")
    kind = lambda *v: row(*v).select(D.evidence_type(*[F.col(c) for c in row(*v).columns]).alias("x")).first().x
    assert kind("quiz_answer", None, 0.9, True, None, None, None) == "incorrect" and kind("view", True, 0.9, None, None, None, None) == "correct"
    assert kind("assignment_submitted", None, None, None, 0.6, None, None) == "assignment_correct" and kind("assignment_submitted", None, None, None, None, True, None) == "affirmation"
    assert kind("view", None, None, None, None, None, None) == "confusion" and kind("view", None, 0.5, None, None, None, 0.7) == "correct"


def test_alignment_costs_the_least():
    rng = random.Random(3)
    for _ in range(200):
        a, b = (sorted(rng.randint(0, 30) for _ in range(rng.randint(0, 5))) for _ in range(2))
        got = titles.align(a, b)
        if len(a) > len(b):
            assert got == []
            continue
        cost = lambda places: sum(abs(x - b[p]) for x, p in zip(a, places, strict=True))
        assert got == sorted(set(got)) and cost(got) == min(map(cost, itertools.combinations(range(len(b)), len(a))))


def test_longest_increasing_run_is_longest(spark):
    rng = random.Random(6)
    lists = [[rng.randint(0, 9) for _ in range(rng.randint(0, 9))] for _ in range(30)]
    for xs, run in zip(lists, column_of(spark, lists, splitting.longest_increasing, "array<int>"), strict=True):
        rising = [c for n in range(len(xs) + 1) for c in itertools.combinations(xs, n) if all(p < q for p, q in zip(c, c[1:]))]
        assert tuple(run) in rising and len(run) == max(map(len, rising))


def test_best_title(spark):
    asked = spark.createDataFrame([(1, "Water cycle"), (2, "explain the water cycle"), (3, "water"), (4, "zebra"), (5, None), (6, "rocks")], "k int, query string")
    known = spark.createDataFrame([(1, "The water cycle"), (2, "Water Cycle!"), (3, "Rocks"), (4, "rocks"), (5, None)], "t int, title string")
    got = {r.k: (r.t, r.score) for r in titles.best_title(asked, known, "k", "t", 50.0).collect()}
    assert got == {1: (2, 100.0), 2: (1, 85.0), 3: (1, 52.0), 6: (3, 100.0)}


def test_value_of_the_next_key(spark):
    rows = [(i * 3, f"v{i}" if i % 4 else None) for i in range(50)]
    frame = spark.createDataFrame(rows, "k long, v string")
    got = {r.k: r.n for r in W.with_next(frame, "k", "v", "n", 7).collect()}
    assert got == {k: rows[i + 1][1] if i + 1 < len(rows) else None for i, (k, _) in enumerate(rows)}
    assert W.with_next(frame.where("false"), "k", "v", "n", 7).count() == 0


def test_filters_with_a_sentinel(spark):
    frame = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "s string, n int")
    assert tables.chosen(frame, {"s": "all", "n": None}).count() == 3 and tables.chosen(frame, {"s": ["a", "b"]}, F.col("n") > 1).count() == 1
    assert column_of(spark, [["X", "y"], [], None], lambda c: tables.contains_any_case(c, "Y"), "array<string>") == [True, False, None]


def test_echo_of_speech(spark):
    score = lambda user, tutor: spark.range(1).select(splitting.echo(F.lit(user), F.lit(tutor)).alias("x")).first().x
    tutor = "Photosynthesis is the process plants use to make food from sunlight"
    assert score("photosynthesis is the process plants use to make food", tutor) > 0.7 and score("photosynthesis is the process plants use", tutor) > 0.7
    assert score("what is mitochondria", tutor) <= 0.7 and score("can you explain photosynthesis again", tutor) <= 0.7 and score("stop", tutor) <= 0.7
    greeting = "Hi Mayra, welcome back. What would you like to learn today from Chapter 2?"
    assert score("what would", greeting) == 1.0 and score("what is photosynthesis", greeting) <= 0.7
    assert score("the mughals", "Later the Mughals take over, and the map changes again.") <= 0.7
    assert score("Mira you are mixing two things in", "Ah, Mayra, you're mixing two things. In Chapter 2, we don't count maps.") > 0.7


def test_texts_as_lines_and_back(spark):
    texts = ["", "a\nb\r\nc", "\\n", "\\\\n\n", "end\\", "\\r\r", "ç\n"]
    lines = column_of(spark, texts, tables.one_line)
    assert not any("\n" in x or "\r" in x for x in lines) and column_of(spark, lines, tables.from_one_line) == texts


def test_a_prefix_is_copied_and_deleted(spark, tmp_path):
    spark.range(20).selectExpr("id", "id % 3 AS k").write.partitionBy("k").parquet(str(tmp_path / "a"))
    assert tables.copy_prefix(spark, str(tmp_path / "a"), str(tmp_path / "b")) > 0
    assert tables.delete_prefix(spark, str(tmp_path / "b" / "k=1")) and not tables.delete_prefix(spark, str(tmp_path / "none"))
    assert spark.read.parquet(str(tmp_path / "b")).count() == 13 and spark.read.parquet(str(tmp_path / "a")).count() == 20


def test_what_got_worse(spark):
    from tideline.operators import evaluation as E

    schema = "phase string, ms double, score double, retrieval_mrr double, hallucination_rate double, status string"
    before = spark.createDataFrame([("a", 6000.0, 0.9, 0.8, 0.0, "PASS"), ("b", 100.0, 0.5, None, 0.1, "PASS"), ("c", 9000.0, 0.9, 0.9, 0.0, "SKIP"), ("d", 1.0, 0.0, 0.5, 0.0, "PASS")], schema)
    now = spark.createDataFrame([("a", 9001.0, 0.84, 0.7, 0.0, "PASS"), ("b", 900.0, 0.46, 0.1, 0.2, "WARN"), ("c", 99000.0, 0.1, 0.1, 0.9, "PASS"), ("d", 1.0, -1.0, 0.46, 0.05, "PASS")], schema)
    told = lambda a, b: sorted((r.phase, r.kind, r.measure) for r in E.regressions(a, b).collect())
    assert told(before, now) == [("a", "latency_increase", "ms"), ("a", "quality_drop", "score"), ("a", "retrieval_degradation", "retrieval_mrr"), ("b", "hallucination_increase", "hallucination_rate")]
    assert told(before.where("phase = 'a'"), now) == []  # three phases more: another kind of run
    assert told(before.where("phase <> 'b'"), now)[0][0] == "a" and told(before, before) == []


def test_echo_of_the_first_words(spark):
    tutor = "the quick brown fox jumps over the lazy dog"
    assert spark.range(1).select(splitting.echo(F.lit("you said " + tutor + " why"), F.lit(tutor)).alias("x")).first().x == 1.0


def test_a_long_row_of_single_letters_is_torn_and_ends(spark):
    """A repeated group matched a level deeper for each letter."""
    text = "the quick words here and there " * 8000 + "a b " * 20000 + "end"
    rows = spark.createDataFrame([(1, text), (2, "one two six ten a b c d"), (3, "one two six ten a b c de"), (4, "one two six ten xa b c d")], "i long, t string")
    assert [r.x for r in rows.orderBy("i").select(D.letter_spaced(F.col("t")).alias("x")).collect()] == [True, True, False, False]


def test_words_of_all_subjects_are_found_side_by_side(spark):
    rows = spark.createDataFrame([(1, "Periodic table, atom"), (2, "atoms, xmap_ map1"), (3, "parliament war-map"), (4, None)], "i long, t string")
    got = [r.x for r in rows.orderBy("i").select(D.subject_tags(F.col("t")).alias("x")).collect()]
    assert got == [["chemistry", "nuclear_physics"], [], ["geography", "history", "civics"], []]


def test_patterns_of_subjects_run_once_a_text(spark):
    texts = spark.createDataFrame([("x",)], "t string")
    plan = texts.select(D.subject_tags(F.col("t")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("photosynthesis") <= 2 and "RLIKE" not in plan
