"""Column functions over text: normalisation, tokens, quality, privacy, provenance labels. They run in the JVM; clean_text, good_text, text_tokens and code_signals are the same rules in Python."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that count as white space, and those that end a line.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0  -     　]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
#: Control characters other than tab and line feed.
CONTROLS = "".join(chr(c) for c in range(32) if c not in (9, 10))
#: Word characters by Unicode category, so that every engine agrees on them.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"

#: File suffixes and provenance words of source code.
CODE_SUFFIXES = (".c", ".cc", ".cpp", ".cs", ".css", ".go", ".h", ".hpp", ".html", ".java", ".js", ".jsx", ".kt", ".php", ".py", ".rb", ".rs", ".sh", ".sql", ".swift", ".ts", ".tsx", ".vue")
CODE_HINTS = ("codeparrot", "github", "starcoder", "the-stack", "source-code")
CODE_SIGNALS = (
    r"(?m)^\s*(def|class|import|from|function|interface)\s+\w+",
    r"(?m)^\s*(const|let|var)\s+\w+\s*=",
    r"(?m)[{};]\s*(//.*)?$",
    r"(?m)^\s*#(include|define|!/)",
)

#: The patterns of the privacy reasons.
EMAIL = r"(?i)(?<![A-Z0-9._%+-])[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}(?![A-Z0-9.-])"
LABELED_SECRET = r"""(?i)\b(?:password|passwd|pwd|api[ _-]?key|access[ _-]?token|auth[ _-]?token|secret)\b\s*(?:is\s+|[:=]\s*)["']?[^\s<>{}"']{4,}"""
SSN = r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)"
LABELED_PHONE = r"(?i)\b(?:phone|mobile|telephone|tel)\b\s*(?:is\s+|[:=]\s*)\+?\d[\d ().-]{7,}\d"
PAYMENT_NUMBER = r"(?<!\d)(?:\d[ -]?){12,18}\d(?!\d)"
PRIVACY = {"email": EMAIL, "labeled_phone": LABELED_PHONE, "labeled_secret": LABELED_SECRET, "payment_card": PAYMENT_NUMBER, "ssn": SSN}


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: inside a lambda an expression would be computed for every element."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+\z", "")


def collapse(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return strip(F.regexp_replace(text, f"{SPACE}+", " "))


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def casefold(text: Column) -> Column:
    """Lower case with sharp s spelt out: full case folding of the Latin script."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def tokens(text: Column, case_sensitive: bool = False) -> Column:
    """Words and single punctuation marks."""
    return F.regexp_extract_all(text if case_sensitive else casefold(text), F.lit(TOKEN), 0)


def match_text(text: Column) -> Column:
    """Tokens joined by one space: what exact matching compares."""
    return F.array_join(tokens(text), " ")


def shingles(words: Column, size: int) -> Column:
    """Distinct runs of ``size`` words joined by NUL; none if there are fewer words."""

    def runs(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - size + 1)
        found = F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(w, i, size), "\0")))
        return F.when(F.size(w) >= size, found).otherwise(F.array().cast("array<string>"))

    return let(words, runs)


def shingle_hashes(words: Column, size: int) -> Column:
    """Distinct 64-bit hashes of runs of ``size`` words, each hash going on from that of the words before; none if there are fewer words. No joined string is made."""

    def runs(w: Column) -> Column:
        found = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*(w[i + j] for j in range(size))))
        return F.when(F.size(w) >= size, F.array_distinct(found)).otherwise(F.array().cast("array<bigint>"))

    return let(words, runs)


def repetition_ratio(text: Column) -> Column:
    """1 - distinct / all over lines of 20 characters or more, compared in lower case with white space collapsed; 0 without such lines."""
    lines = F.filter(F.split(text, LINE_END, -1), lambda x: F.length(x) >= 20)
    lines = F.filter(F.transform(lines, lambda x: collapse(F.lower(x))), lambda x: F.length(x) >= 20)
    return let(lines, lambda x: F.when(F.size(x) == 0, F.lit(0.0)).otherwise(1.0 - F.size(F.array_distinct(x)) / F.size(x)))


def quality_text(text: Column) -> Column:
    return strip(unix_lines(text))


def _clean_reason(clean: Column, min_chars: int, max_control_ratio: float, max_repetition_ratio: float) -> Column:
    size = F.greatest(F.lit(1), F.length(clean))
    controls = F.length(clean) - F.length(F.translate(clean, CONTROLS, ""))
    broken = F.length(clean) - F.length(F.translate(clean, "\ufffd", ""))
    return (
        F.when(F.length(clean) < min_chars, "too_short")
        .when(controls / size > max_control_ratio, "control_characters")
        .when(broken / size > 0.001, "replacement_characters")
        .when(repetition_ratio(clean) > max_repetition_ratio, "repetitive")
        .otherwise("")
    )


def quality_reason(text: Column, min_chars: int = 200, max_chars: int = 2_000_000, max_control_ratio: float = 0.01, max_repetition_ratio: float = 0.35) -> Column:
    """The first reason to reject a text, empty if there is none. The raw length is looked at before anything is copied."""
    of = lambda clean: _clean_reason(clean, min_chars, max_control_ratio, max_repetition_ratio)
    return F.when(text.isNull(), "missing_text").when(F.length(text) > max_chars, "too_long").otherwise(let(quality_text(text), of))


def quality_facts(text: Column, min_chars: int = 200, max_chars: int = 2_000_000, max_control_ratio: float = 0.01, max_repetition_ratio: float = 0.35) -> Column:
    """A struct of reason, digest (of the cleaned text, white space collapsed), clean_sha and chars (of the cleaned text): the text is cleaned once. Null and too long texts have a reason only."""

    def of(clean: Column) -> Column:
        reason = _clean_reason(clean, min_chars, max_control_ratio, max_repetition_ratio)
        return F.struct(reason.alias("reason"), F.sha2(collapse(clean), 256).alias("digest"), F.sha2(clean, 256).alias("clean_sha"), F.length(clean).cast("bigint").alias("chars"))

    none = lambda kind: F.lit(None).cast(kind)
    only = lambda reason: F.struct(F.lit(reason).alias("reason"), none("string").alias("digest"), none("string").alias("clean_sha"), none("bigint").alias("chars"))
    return F.when(text.isNull(), only("missing_text")).when(F.length(text) > max_chars, only("too_long")).otherwise(let(quality_text(text), of))


def content_digest(text: Column) -> Column:
    """SHA-256 of the cleaned text with white space collapsed, case kept."""
    return F.sha2(collapse(quality_text(text)), 256)


def luhn_valid(number: Column) -> Column:
    """13 to 19 digits, not all alike, whose Luhn sum is divisible by ten."""
    digits = F.transform(F.split(F.regexp_replace(number, r"\D", ""), ""), lambda d: d.cast("int"))
    digits = F.filter(digits, lambda d: d.isNotNull())
    size = F.size(digits)
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == size % 2, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d))
    total = F.aggregate(doubled, F.lit(0), lambda a, d: a + d)
    return size.between(13, 19) & (F.size(F.array_distinct(digits)) > 1) & (total % 10 == 0)


def privacy_reasons(text: Column, patterns: dict[str, str] | None = None) -> Column:
    """The sorted reasons for which a text may hold private data. ``patterns`` replaces those of some reasons; the last group of payment_card's, if it has one, is the number."""
    own = PRIVACY | (patterns or {})
    numbers = F.regexp_extract_all(text, F.lit(own["payment_card"]), re.compile(own["payment_card"].replace(r"\z", r"\Z")).groups)
    holds = {reason: text.rlike(pattern) for reason, pattern in own.items()} | {"payment_card": F.exists(numbers, luhn_valid)}
    found = F.array(*(F.when(holds[reason], F.lit(reason)) for reason in sorted(holds)))
    return F.filter(found, lambda r: r.isNotNull())


def code_like(text: Column, source: Column, provenance: Column | None = None) -> Column:
    """Source code by suffix, by provenance, or by two of four signals in the first 16384 characters."""
    path = F.when(source.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), F.regexp_extract(source, r"^[^:]+://[^/?#]*([^?#]*)", 1)).otherwise(source)
    suffix = F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))
    words = F.lower(F.concat_ws(" ", source, provenance) if provenance is not None else source)
    hinted = F.lit(False)
    for hint in CODE_HINTS:
        hinted = hinted | words.contains(hint)
    sample = F.substring(text, 1, 16384)
    signals = sum((F.when(sample.rlike(p), 1).otherwise(0) for p in CODE_SIGNALS), F.lit(0))
    return F.coalesce(suffix.isin(*CODE_SUFFIXES) | hinted | (signals >= 2), F.lit(False))


def clean_text(text: str) -> str:
    """What quality_text gives, in Python: its white space is SPACE."""
    return text.replace("\r\n", "\n").replace("\r", "\n").strip()


_CONTROL, _TOKEN = re.compile(f"[{re.escape(CONTROLS)}]"), re.compile(r"\w+|[^\w \t-\r]")


def good_text(text: str, min_chars: int = 200, max_chars: int = 2_000_000, max_control_ratio: float = 0.01, max_repetition_ratio: float = 0.35) -> str | None:
    """The cleaned text if quality_reason has nothing against it, in Python. A pass over a corpus takes a tenth of the time of the expressions there."""
    if len(text) > max_chars or len(clean := clean_text(text)) < min_chars:
        return None
    size = max(1, len(clean))
    if len(_CONTROL.findall(clean)) / size > max_control_ratio or clean.count("\ufffd") / size > 0.001:
        return None
    lines = [x for x in (" ".join(x.lower().split()) for x in clean.splitlines() if len(x) >= 20) if len(x) >= 20]
    return None if lines and 1.0 - len(set(lines)) / len(lines) > max_repetition_ratio else clean


def text_tokens(text: str) -> list[str]:
    """What tokens gives with case kept, in Python."""
    return _TOKEN.findall(text)


#: CODE_SIGNALS with Java's line ends and ASCII classes, for texts without carriage returns.
_START, _BLANK, _END = r"(?:\A|(?<=[\n\x85\u2028\u2029]))", r"[ \t-\r]", r"[\n\r\x85\u2028\u2029]"
_SIGNALS = [re.compile(p.replace("(?m)^", _START).replace(r"\s", _BLANK).replace(r"(//.*)?$", rf"(//[^{_END[1:]}*)?(?={_END}|\Z)").replace(r"\w", "[A-Za-z0-9_]").replace("(?m)", "")) for p in CODE_SIGNALS]


def code_signals(clean: str) -> bool:
    """Whether a cleaned text has two of code_like's signals, in Python."""
    sample = clean[:16384]
    return sum(p.search(sample) is not None for p in _SIGNALS) >= 2


def bounded_label(value: Column, max_chars: int = 160) -> Column:
    """A label of bounded length: beyond it, the start and 20 digits of the whole value's SHA-256."""
    clean = strip(value)
    clean = F.when(F.coalesce(clean, F.lit("")) == "", "unknown").otherwise(clean)
    return F.when(F.length(clean) <= max_chars, clean).otherwise(F.concat(F.substring(clean, 1, max_chars - 22), F.lit("…#"), F.substring(F.sha2(clean, 256), 1, 20)))


def source_family(source: Column, mixture: Column | None = None, dataset: Column | None = None) -> Column:
    """Provenance as one label: mixture, dataset, web host, scheme, file suffix or name."""
    scheme = F.lower(F.regexp_extract(source, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    place = F.regexp_extract(source, r"^[^:]+://([^/?#]*)", 1)
    path = F.filter(F.split(F.regexp_extract(source, r"^[^:]+://[^/?#]*([^?#]*)", 1), "/"), lambda x: x != "")
    host = F.lower(F.regexp_replace(F.regexp_replace(place, r"^.*@", ""), r":\d*$", ""))
    suffix = F.lower(F.regexp_extract(source, r"[^/](\.[^./\\]+)$", 1))
    hf = F.when(F.size(path) > 0, F.array_join(F.slice(path, 1, 2), "/")).otherwise("unknown")
    label = (
        F.when((scheme == "hf") & (place == "datasets"), F.concat(F.lit("dataset:"), hf))
        .when(scheme.isin("http", "https"), F.concat(F.lit("web:"), F.when(host == "", "unknown").otherwise(host)))
        .when(scheme != "", F.concat(F.lit("scheme:"), scheme))
        .when(source.contains("/") | source.contains("\\"), F.concat(F.lit("file:"), F.when(suffix == "", "no-extension").otherwise(suffix)))
        .otherwise(F.concat(F.lit("named:"), F.coalesce(source, F.lit(""))))
    )
    for name, value in (("dataset", dataset), ("mixture", mixture)):
        if value is not None:
            label = F.when(F.coalesce(strip(value), F.lit("")) != "", F.concat(F.lit(f"{name}:"), value)).otherwise(label)
    return bounded_label(label)


def license_family(name: Column) -> Column:
    return bounded_label(casefold(name))


def stable_source(*parts: Column) -> Column:
    """hf://datasets/ and the parts that are neither null nor empty."""
    return F.concat(F.lit("hf://datasets/"), F.array_join(F.filter(F.array(*parts), lambda p: F.coalesce(p, F.lit("")) != ""), "/"))


def source_label(name: Column) -> Column:
    """A source's name without its fit tag."""
    return F.regexp_replace(name, r"^fit\d+-", "")


def hash_prefix(text: Column, digits: int = 8) -> Column:
    """The first hex digits of a SHA-256 as a number."""
    return F.conv(F.substring(F.sha2(text, 256), 1, digits), 16, 10).cast("bigint")


def hash_bucket(label: str, key: Column, buckets: int = 100) -> Column:
    return hash_prefix(F.concat(F.lit(f"{label}:"), key.cast("string"))) % buckets


def hash_selected(seed: int, key: Column, fraction: float) -> Column:
    """A Bernoulli draw that depends on seed and key alone."""
    return hash_prefix(F.concat(F.lit(f"{seed}:"), key.cast("string"))) < int(fraction * 2**32)


def truncate_utf8(text: Column, limit: int) -> Column:
    """The longest prefix of whole characters in at most ``limit`` bytes."""
    cut = F.substring(F.encode(text, "UTF-8"), 1, limit)
    whole = F.regexp_replace(F.hex(cut), "(?:C[0-9A-F]|D[0-9A-F]|E[0-9A-F](?:[89AB][0-9A-F])?|F[0-9A-F](?:[89AB][0-9A-F]){0,2})$", "")
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.decode(F.unhex(whole), "UTF-8"))
