"""Text functions: error fingerprints, slugs, keyword and similarity scores, redaction, cleaning, classifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Verbs of each level of the taxonomy, in the order that ties follow.
BLOOM = {
    "remember": "define|list|name|identify|recall|state|label",
    "understand": "explain|describe|summarize|interpret|classify",
    "apply": "solve|calculate|apply|demonstrate|use|compute",
    "analyze": "compare|contrast|analyze|differentiate|examine",
    "evaluate": "evaluate|justify|assess|critique|defend",
    "create": "design|construct|create|develop|formulate|invent",
}
#: Base difficulty of each level.
BLOOM_DIFFICULTY = {"remember": 1.0, "understand": 2.0, "apply": 3.0, "analyze": 3.5, "evaluate": 4.0, "create": 4.5}
#: Words that carry no content.
STOPWORDS = ["the", "a", "an", "and", "or", "to", "of", "in", "on", "for", "is", "are", "was", "were", "be", "as", "by", "with", "that", "this", "it", "from"]

_UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def normalised_error(message: Column) -> Column:
    """Lower case with UUIDs, long hexadecimal ids and numbers replaced, single spaces, 400 characters at most."""
    x = F.lower(F.trim(F.coalesce(message, F.lit(""))))
    for pattern, by in ((_UUID, "<uuid>"), (r"\b[0-9a-f]{16,}\b", "<id>"), (r"\b[0-9]+\b", "<n>"), (r"\s+", " ")):
        x = F.regexp_replace(x, pattern, by)
    return F.substring(x, 1, 400)


def error_fingerprint(title: Column, culprit: Column, service: Column, environment: Column) -> Column:
    parts = [normalised_error(title), normalised_error(culprit), F.lower(F.coalesce(service, F.lit(""))), F.lower(F.coalesce(environment, F.lit("production")))]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 40)


def slug(text: Column, most: int = 200) -> Column:
    """Lower-case letters and digits joined by underscores; 'general' for nothing."""
    x = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(F.substring(x, 1, most), F.lit("")), F.lit("general"))


def query_terms(text: Column) -> Column:
    """Distinct words of two characters or more, without numbers of three digits or fewer."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9_]+)"), 1)
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 2) & ~w.rlike("^[0-9]{1,3}$")))


def keyword_score(terms: Column, text: Column) -> Column:
    """How many terms occur in the text, inside words too."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.size(F.filter(terms, lambda t: F.contains(low, t)))


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def redacted(text: Column, most: int = 2000) -> Column:
    """Bearer tokens masked, long texts cut with a mark."""
    x = F.regexp_replace(text, r"(?i)(bearer\s+)[A-Za-z0-9\-._~+/]+=*", "$1[REDACTED]")
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most), F.lit("…[truncated]"))).otherwise(x)


def redacted_map(m: Column) -> Column:
    """A flat map with the values of secret and conversation keys hidden."""
    hide = r"(?i)password|passwd|secret|token|authorization|api[_-]?key|cookie|credential|refresh|jwt|bearer|transcript|audio|conversation|message_body|pcm|recording"
    return F.transform_values(m, lambda k, v: F.when(k.rlike(hide), F.lit("[REDACTED]")).otherwise(redacted(v)))


def bloom(text: Column) -> Column:
    """The level with the most verbs; ties go to the earlier level, no verb means 'understand'."""
    verbs = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"\b({'|'.join(BLOOM.values())})\b"), 1)

    def count(found: Column, own: list[str]) -> Column:
        return F.size(F.filter(found, lambda v: v.isin(own)))

    def best(found: Column) -> Column:
        hits = [F.struct(count(found, own.split("|")).alias("n"), F.lit(-i).alias("i"), F.lit(level).alias("level")) for i, (level, own) in enumerate(BLOOM.items())]
        return _let(F.array_max(F.array(*hits)), lambda x: F.when(x["n"] > 0, x["level"]).otherwise("understand"))

    return _let(verbs, best)


def difficulty(level: Column, n_words: Column, grade: int = 6, digits: int = 2) -> Column:
    def base(of: Column) -> Column:
        out = F.lit(2.5)
        for k, v in BLOOM_DIFFICULTY.items():
            out = F.when(of == k, F.lit(v)).otherwise(out)
        return out

    # The level is bound once; as a column it would be found again for each of its names.
    x = _let(level, base) + min(1.5, grade / 10.0) * 0.3 + F.least(F.lit(1.0), n_words / 200.0) * 0.2
    return F.bround(F.least(F.lit(5.0), F.greatest(F.lit(1.0), x)), digits)


def content_tokens(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1)
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(STOPWORDS))


def groundedness(answer: Column, context: Column) -> Column:
    """Share of the answer's content tokens that occur in the context, inside words too; 0 without tokens or context."""
    low = F.lower(F.coalesce(context, F.lit("")))
    share = _let(content_tokens(answer), lambda t: F.coalesce(F.try_divide(F.size(F.filter(t, lambda w: F.contains(low, w))), F.size(t)), F.lit(0.0)))
    return F.when(F.trim(low) == "", F.lit(0.0)).otherwise(share)


def token_length(text: Column) -> Column:
    """A quarter of the characters, 1 at least."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / 4).cast("int"))


def chunk_issues(text: Column, low: int = 50, high: int = 1200) -> Column:
    """Names of what is wrong with a chunk, in a fixed order."""
    n = token_length(text)
    rows = F.regexp_count(text, F.lit(r"(?m)^\s*\|.+\|\s*$"))
    found = [
        F.when(n < low, "too_small"),
        F.when(n > high, "too_large"),
        F.when(F.trim(text).rlike(r"[A-Za-z]-\s*$"), "broken_paragraph_hyphen"),
        F.when(text.rlike(r"(?:^|\n)\s*(?:[-*]|[0-9]+[.)])\s*$"), "broken_list"),
        F.when(rows == 1, "possible_split_table"),
        F.when(text.rlike(r"(?i)\b(?:fig(?:ure)?\.?\s*[0-9])") & ~F.contains(F.lower(text), F.lit("caption")), "figure_mention_without_association"),
    ]
    return F.array_compact(F.array(*found))


def cleaned(text: Column, boilerplate: list[str] = ()) -> Column:
    """Boilerplate lines' tails removed, hyphenated line breaks joined, three or more line feeds made two, trimmed."""
    x = F.coalesce(text, F.lit(""))
    for phrase in boilerplate:
        x = F.regexp_replace(x, "(?i)" + "".join("\\" + c if not c.isalnum() and c != " " else c for c in phrase) + r"[^\n]*", "")
    x = F.regexp_replace(x, r"\b([a-zA-Z]{2,})-[ \t]*\n\s*([a-zA-Z]{2,})\b", "$1$2")
    return F.trim(F.regexp_replace(x, r"\n{3,}", "\n\n"))


def title_score(query: Column, title: Column) -> Column:
    """0 to 100 for how well a title fits a query: equal, contained, mostly overlapping, or a single word."""
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    tokens = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda w: w != ""))

    def score(q: Column, t: Column) -> Column:
        a, b = tokens(q), tokens(t)
        both = F.size(F.array_intersect(a, b))
        share = both / F.greatest(F.size(a), F.lit(1))
        held = F.contains(t, q) | F.contains(q, t)
        return (
            F.when((q == "") | (t == ""), 0.0).when(q == t, 100.0).when(held & (F.size(a) == 1) & (F.size(b) >= 2), 52.0).when(held, 85.0)
            .when((share >= 0.8) & (F.size(a) >= 2), 70.0 + share * 10).when((share >= 1.0) & (F.size(a) == 1) & (both == 1), 55.0).otherwise(0.0)
        )

    return _let(norm(query), lambda q: _let(norm(title), lambda t: score(q, t)))


def markup_stripped(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"\s+", " "))
