"""Text expressions: tokens, set overlaps, chunks, clean-up and label rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Word lists and patterns that results depend on.
STOP_WORDS = "the a an and or to of in on for is be as at by with from that this it we you our are was were been being have has had do does not no yes if then than so but into via".split()
LEXICAL_STOP = "attacks and to the a an of is for with or then".split()
INTERFACE = (
    "open stop residue measure audit restrict certify strain holonomy sequence prior energy geometry smoke test verify claim force park defer "
    "plane pack ingest scout local model goal non_goal success constraint falsifier code file api diff patch import theta bishop rama pro gly backbone"
).split()
LAW_CORE = "open stop residue measure audit restrict certify force park prior claim".split()
CHROME = [
    r"(?i)<system-reminder>[\s\S]*?</system-reminder>\s*",
    r"(?i)Scheduled task\s+\S+\s*\(every[^)]*\)\.?[^\n]*\n?",
    r"(?i)Earlier iterations, if any, appear above\.\s*",
    r"(?i)Run the task below\.[^\n]*\n?",
    r"(?i)End with a short status:[^\n]*\n?",
    r"(?i)</?system-reminder>",
]
PLACEHOLDER = r"(?i)^(?:\.\.\.|…|\.{2,}|n/?a|tbd|todo|none|null|unknown|placeholder|fill.?in|string|text|reason|note|risk|missing|\s*)$"
FILLER = r"(?i)(task is ongoing|monitoring required|smooth execution|ensure compliance|further analysis|as appropriate|etc\.?$)"
SECTION = r"(?m)^(\s*\d+\.(?:\d+\.)?\s+[A-Z])"
TITLE = r"^(\d+\.(?:\d+\.)?\s+[^\n.]{5,80})"
TAGS = {
    "geometry": ["manifold", "geodesic", "riemann", "helical", "shape"],
    "efficiency": ["order of magnitude", "10^", "compute", "efficiency", "sparse"],
    "active_state": ["active inference", "cache", "predictive", "free energy"],
    "liquid": ["liquid neural", "lnn", "liquid ai"],
    "neuromorphic": ["spiking", "loihi", "neuromorphic", "snn"],
    "commercial": ["verses", "genius", "numenta", "thousand brain"],
    "physics": ["landauer", "symplectic", "thermodynamic", "entropy"],
    "metric": ["aboutness", "agreement", "nli", "jina", "dual_enter", "cosine"],
    "law": ["open", "stop", "residue", "restrict", "audit", "measure"],
    "lms": ["lm studio", "lfm", "context_length", "gguf"],
}


def words_of(words: list[str]) -> Column:
    return F.array(*(F.lit(w) for w in words))


def empty_text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def retrieval_tokens(text: Column) -> Column:
    """Distinct runs of three or more letters, digits and underscores."""
    return F.array_distinct(F.regexp_extract_all(F.lower(empty_text(text)), F.lit("([a-z0-9_]{3,})"), F.lit(1)))


def projection_tokens(text: Column) -> Column:
    """Identifier-like tokens without trailing marks, stop words and single characters."""
    raw = F.regexp_extract_all(F.lower(empty_text(text)), F.lit("([a-z_][a-z0-9_./+-]*)"), F.lit(1))
    return F.filter(F.transform(raw, lambda t: F.btrim(t, F.lit("._-"))), lambda t: (F.length(t) >= 2) & ~t.isin(STOP_WORDS))


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def interface_hits(tokens: Column) -> Column:
    """Interface words that a token extends, or that extend a token of four or more characters; in order.

    The tokens become one text with a line break on either side of each, in which each word and its beginnings are sought.
    """

    def near(v: str, line: Column) -> Column:
        parts = [f"\n{v}", *(f"\n{v[:n]}\n" for n in range(4, len(v)))]
        hit = line.contains(parts[0])
        for x in parts[1:]:
            hit = hit | line.contains(x)
        return F.when(hit, v)

    return let(F.concat(F.lit("\n"), F.array_join(tokens, "\n"), F.lit("\n")), lambda line: F.array_compact(F.array(*(near(v, line) for v in sorted(INTERFACE)))))


def lexical_tokens(text: Column) -> Column:
    parts = F.split(F.regexp_replace(F.lower(empty_text(text)), r"[^a-z0-9\s]", " "), r"\s+")
    return F.array_distinct(F.filter(parts, lambda t: (t != "") & ~t.isin(LEXICAL_STOP)))


def trigrams(text: Column) -> Column:
    s = F.trim(F.regexp_replace(F.lower(empty_text(text)), r"\s+", " "))
    grams = lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - 3), lambda i: F.concat(c[i], c[i + 1], c[i + 2]))
    return let(F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0)), lambda c: F.when(F.size(c) >= 3, F.array_distinct(grams(c))).otherwise(F.array().cast("array<string>")))


def jaccard(a: Column, b: Column, empty: float) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / both)


def dice(a: Column, b: Column) -> Column:
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2 * F.size(F.array_intersect(a, b)) / total)


def strip_chrome(text: Column) -> Column:
    """text without scheduler and reminder wrappers, runs of blank lines cut to one."""
    for pattern in CHROME:
        text = F.regexp_replace(text, pattern, "")
    return F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def is_placeholder(text: Column) -> Column:
    t = F.regexp_replace(empty_text(text), r"^\s+|\s+$", "")
    return (F.length(t) < 2) | t.rlike(PLACEHOLDER)


def is_filler(text: Column) -> Column:
    t = F.regexp_replace(empty_text(text), r"^\s+|\s+$", "")
    template = t.contains("...") | t.contains("…")
    return (F.length(t) < 12) | (t.rlike(FILLER) & (F.length(t) < 120)) | (template & (F.length(t) < 40))


def estimated_tokens(text: Column) -> Column:
    t = empty_text(text)
    words = F.floor(F.size(F.regexp_extract_all(t, F.lit(r"(\S+)"), F.lit(1))) * 1.3)
    return F.when(t == "", 0).otherwise(F.greatest(words, F.greatest(F.lit(1), F.floor(F.length(t) / 4)))).cast("long")


def chunks(docs: DataFrame, id_col: str, text_col: str, size: int = 1200) -> DataFrame:
    """Windows of at most size characters of each numbered section: id, chunk_id, kind, title, n_chars, tags, text.

    White space is one space. Sections under 80 and windows under 60 characters go. A null text has no chunk.
    """
    parts = F.split(F.regexp_replace(text_col, SECTION, "\x01$1"), "\x01")
    parts = F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    section = docs.select(id_col, F.posexplode(F.filter(parts, lambda p: F.length(p) >= 80)).alias("_s", "_part"))
    starts = F.sequence(F.lit(0), F.length("_part") - 1, F.lit(size))
    window = section.select(id_col, "_s", F.explode(F.transform(starts, lambda i: F.struct(i.alias("at"), F.substring("_part", i + 1, F.lit(size)).alias("text")))).alias("_w"))
    window = window.select(id_col, F.struct("_s", "_w.at").alias("_order"), F.col("_w.text").alias("text")).filter(F.length("text") >= 60)
    numbered = window.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("_order", "text"))).alias("_all")).select(id_col, F.posexplode("_all").alias("_at", "_c"))
    text = F.col("_c.text")
    low, titled = F.lower(text), F.regexp_extract(text, TITLE, 1)
    plain = F.when(text.startswith("```") | text.startswith("---"), "untitled").otherwise(F.substring(text, 1, 80))
    tags = [F.when(F.greatest(*(low.contains(k).cast("int") for k in keys)) == 1, tag) for tag, keys in TAGS.items()]
    return numbered.select(
        id_col,
        F.format_string("C%04d", F.col("_at") + 1).alias("chunk_id"),
        F.when(titled != "", "section").otherwise("window").alias("kind"),
        F.trim(F.when(titled != "", titled).otherwise(plain)).alias("title"),
        F.length(text).alias("n_chars"),
        F.concat_ws(",", *tags).alias("tags"),
        text.alias("text"),
    )
