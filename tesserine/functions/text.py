"""Column-to-column text functions; all run inside the JVM.

Regular expressions are Java's; ``(?U)`` gives the Unicode classes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Fixed value: the greeting that a deduplication key leaves out.
GREETING = r"^(hi|hello|dear|hey)\b[\s,]*(doctor|dr)?[\s,]*"


def clean(c: Column) -> Column:
    """No-break spaces and carriage returns plain, runs of blanks one, at most one empty line, trimmed; NULL becomes the empty string."""
    t = F.translate(F.coalesce(c, F.lit("")), " ", " ")
    t = F.regexp_replace(F.regexp_replace(t, "\r\n?", "\n"), "[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(t, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Every run of white space one space, trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


#: Characters of a key that short questions are compared by; keys are whole unless it is asked for.
KEY_CHARS = 800


def dedup_key(c: Column, chars: int | None = None) -> Column:
    """Lower case, ASCII letters and digits only, single spaces, without a leading greeting, cut to ``chars`` if given."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9\s]", " "), r"\s+", " "))
    t = F.regexp_replace(t, GREETING, "")
    return t if chars is None else F.substring(t, 1, chars)


def fingerprint(c: Column) -> Column:
    """SHA-1 of the lower-cased text without punctuation, white space squeezed."""
    return F.sha1(F.regexp_replace(squeeze(F.lower(F.coalesce(c, F.lit("")))), r"(?U)[^\w\s]", ""))


def question_key(c: Column) -> Column:
    """Lower-cased, without white space around; the key questions are matched on."""
    return F.lower(strip(c))


def mostly_ascii(c: Column, share: float = 0.9) -> Column:
    """Whether more than ``share`` of the characters are ASCII; false for the empty text and NULL."""
    n = F.length(F.coalesce(c, F.lit("")))
    return F.when(n > 0, F.length(F.regexp_replace(c, r"[^\x00-\x7F]", "")) / n > share).otherwise(False)


def first_sentence(c: Column, chars: int = 120) -> Column:
    """Up to the first full stop, cut; the cut text itself if nothing stands before the stop."""
    head = F.trim(F.split(F.trim(c), r"\.")[0])
    return F.substring(F.when(head != "", head).otherwise(c), 1, chars)


def tokens(c: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def letter_tokens(c: Column) -> Column:
    """Lower-cased runs of Latin letters, accented ones of Latin-1 and apostrophes included."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-zà-öø-ÿ']+)"), F.lit(1))


def holds_acronym(c: Column, acronym: str) -> Column:
    """Whether the text holds the acronym as a word of its own, in this spelling."""
    return F.rlike(F.coalesce(c, F.lit("")), F.lit(rf"(?U)(?<!\w)\Q{acronym}\E(?!\w)"))


def token_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two token arrays; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def token_set_ratio(a: str, b: str) -> float:
    """Similarity from 0 to 100 of two texts' sorted distinct tokens: the best of three comparisons of common tokens and remainders."""

    def ratio(x: str, y: str) -> float:
        total = len(x) + len(y)
        return 100.0 if not total else 100.0 * 2 * common_subsequence(x, y) / total

    s, t = set(a.split()), set(b.split())
    if not s or not t:
        return 0.0
    both = " ".join(sorted(s & t))
    left, right = (" ".join([both, *sorted(x)]).strip() for x in (s - t, t - s))
    if both and (not s - t or not t - s):
        return 100.0
    return max(ratio(both, left) if both else 0.0, ratio(both, right) if both else 0.0, ratio(left, right))


def common_subsequence(x: str, y: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    if not x or not y:
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(x):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(x)) - 1
    row = full
    for c in y:
        u = row & masks.get(c, 0)
        row = (row + u | row - u) & full
    return len(x) - row.bit_count()


def digit_runs(c: Column) -> Column:
    """Sorted digit runs, escaped code points not counted."""
    return F.array_sort(F.regexp_extract_all(F.regexp_replace(F.coalesce(c, F.lit("")), r"\\u[0-9a-fA-F]{4}", ""), F.lit(r"(?U)(\d+)"), F.lit(1)))


# Fixed value: what a URL is.
URL = r"(https?://[^\s<>\"']+)"


def urls(c: Column) -> Column:
    """Sorted URLs without final punctuation; brackets that they open stay."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(URL), F.lit(1))
    return F.array_sort(F.transform(found, trim_url))


def trim_url(u: Column) -> Column:
    """A URL without final sentence marks and without closers that it does not open."""
    count = lambda x, mark: F.length(x) - F.length(F.translate(x, mark, ""))
    # the final marks and closers one by one from the left: a closer stays while the part up to it opens as many
    tail = F.regexp_extract(u, r"([.,;:!?)\]}]*)$", 1)
    body = F.substring(u, F.lit(1), F.length(u) - F.length(tail))

    def kept(x: Column) -> Column:
        last = F.right(x, F.lit(1))
        closes = F.lit(False)
        for open_, close in (("(", ")"), ("[", "]"), ("{", "}")):
            closes = closes | ((last == close) & (count(x, open_) >= count(x, close)))
        return closes

    steps = F.transform(F.sequence(F.lit(0), F.length(tail)), lambda k: F.concat(body, F.substring(tail, F.lit(1), k)))
    return F.element_at(F.concat(F.array(body), F.filter(steps, kept)), -1)


def without_urls(c: Column) -> Column:
    """The text without its URLs; the marks that end a sentence after one stay."""
    text = F.coalesce(c, F.lit(""))
    return F.aggregate(urls(text), text, lambda acc, u: F.replace(acc, u, F.lit("")))


def mark_counts(c: Column) -> Column:
    """Struct of question marks (the Arabic one too) and exclamation marks outside URLs."""
    t = without_urls(c)
    n = lambda keep: F.length(F.regexp_replace(t, f"[^{keep}]", ""))
    return F.struct(n("?؟").alias("questions"), n("!").alias("exclamations"))


def line_counts(c: Column) -> Column:
    """Struct of line breaks and blank lines."""
    lines = F.split(F.coalesce(c, F.lit("")), "\n")
    inner = F.slice(lines, 2, F.greatest(F.size(lines) - 2, F.lit(0)))
    return F.struct((F.size(lines) - 1).alias("breaks"), F.size(F.filter(inner, lambda x: F.trim(x) == "")).alias("blanks"))


def truthy(c: Column) -> Column:
    """1, true, yes or y in any case; everything else, NULL too, is false."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("1", "true", "yes", "y"), F.lit(False))


# The categories and the substrings that lead to them, in order of precedence.
CATEGORY_NAMES = ("menstrual", "pcos", "fertility", "other", "none")
CATEGORY_PARTS = (("pcos", ("pcos", "pcod", "polycystic")), ("fertility", ("fertil", "conceiv", "pregnan")), ("menstrual", ("menstrual", "period", "cycle", "bleed")))


def normalize_category(c: Column) -> Column:
    """A category name as written, else the first category with a substring in the value, else the value; empty is ``other``."""
    t = F.replace(F.lower(strip(F.coalesce(c, F.lit("")))), F.lit("_"), F.lit("-"))
    out = F.when(t.isin(*CATEGORY_NAMES), t)
    for name, parts in CATEGORY_PARTS:
        out = out.when(contains_any(t, parts), name)
    return out.when(t == "", "other").otherwise(t)


# Spellings of the middle risk level, then substrings of the others, in order of precedence.
DOCTOR_SPELLINGS = ("see-doctor", "see-a-doctor", "doctor", "medical-care", "consult-doctor")
RISK_PARTS = (("urgent", ("urgent", "emergency", "immediate")), ("routine", ("routine", "low")))


def normalize_risk(c: Column) -> Column:
    """The three risk levels from their spellings; unknown values stay."""
    t = F.regexp_replace(F.replace(F.lower(strip(F.coalesce(c, F.lit("")))), F.lit("_"), F.lit("-")), r"(?U)\s+", "-")
    out = F.when(t.isin(*DOCTOR_SPELLINGS), "see-doctor")
    for name, parts in RISK_PARTS:
        out = out.when(contains_any(t, parts), name)
    return out.otherwise(t)


def contains_any(c: Column, parts) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | c.contains(p)
    return out


def first_tier(c: Column, tiers: list[tuple[str, tuple[str, ...]]], default: str) -> Column:
    """The first tier one of whose markers the lower-cased text contains."""
    out = None
    for name, markers in tiers:
        hit = contains_any(F.lower(F.coalesce(c, F.lit(""))), markers)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(default) if out is None else out.otherwise(default)


def weighted_score(c: Column, patterns: list[tuple[str, float]]) -> Column:
    """Struct of the summed weights of the patterns that match and the first five of them."""
    hits = [F.when(F.rlike(c, F.lit(p)), F.struct(F.lit(p).alias("p"), F.lit(float(w)).alias("w"))) for p, w in patterns]
    found = F.filter(F.array(*hits), lambda x: x.isNotNull())
    return F.struct(F.aggregate(found, F.lit(0.0), lambda acc, x: acc + x["w"]).alias("score"), F.array_join(F.slice(F.transform(found, lambda x: F.substring(x["p"], 1, 40)), 1, 5), ";").alias("notes"))
