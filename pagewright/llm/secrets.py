"""Secret scans by pattern and by sliding-window entropy, with DataFrame functions only.

Three base patterns find assigned secrets, access key ids and long hexadecimal runs.  Beyond
them, every maximal run of a character class (hexadecimal digits; base-64 characters) of at
least the window's length is a candidate.  A fold over the candidate's characters keeps the
count of each character in the window and the sum of c * log2(c); moving on by a character
changes two counts and adds two differences, so the window's Shannon entropy costs the same
for every position.  A candidate with a window over the class's limit is a span as a whole, so
that a secret is covered from its first character to its last.

The allow list works on parts: its placeholder words, alphabets and eight equal characters are
blanked out before candidates are sought, so they end a candidate and hide nothing beside them.
A candidate without digits, without letters, or that is a UUID is left out, and so is an added
span inside a base span.

Offsets are in code points, ends exclusive.  A match's place is the length of what stands
before it: the parts between the matches, from a split by the same pattern, and the matches.

Defined results: a null or empty text has no spans, and its digests are those of the empty
string.  Equal rows give equal results; an empty table gives no row.  Working columns begin
with ``__secret``; other columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<start:int,rank:int,stop:int,kind:string>"
NONE = f"array<{SPAN}>"


@dataclass(frozen=True)
class Pattern:
    """A base pattern; a match counts if its ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int
    least: int


@dataclass(frozen=True)
class EntropyClass:
    """Maximal runs of ``alphabet`` (case folded if ``fold``) with windows over ``bits``."""

    kind: str
    characters: str
    alphabet: str
    fold: bool
    window: int
    bits: float


PATTERNS = (
    Pattern("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    Pattern("access", r"AKIA[A-Z0-9]+", 0, 16),
    # a run of 32 or more is the same as a run with its shorter ones dropped
    Pattern("hex", r"[0-9a-f]{32,}+", 0, 32),
)
CLASSES = (
    EntropyClass("entropy_hex", "0-9A-Fa-f", "0123456789abcdef", True, 20, 3.0),
    EntropyClass("entropy_base64", "A-Za-z0-9+/_=-", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", False, 20, 3.9),
)
#: A candidate that one of these matches is no secret.
ALLOW = (r"^[^0-9]*$", r"^[^A-Za-z]*$", r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
#: Parts of a text that belong to no secret, by their length; blanked out from the longest on.
BLANKED = {
    11: r"(?i)placeholder",
    10: r"(?i)0123456789|123456789a|abcdefghij",
    8: r"(?i)changeme",
    7: r"(?i)example",
    6: r"(?i)sample",
    5: r"(?i)dummy|your[_-]",
}
#: So many equal characters are blanked out last.
EQUAL = 8
EQUAL_CHARACTERS = "A-Za-z0-9+/_=-"


def _located(df: DataFrame, text: str, pattern: str, out: str, kind: str, rank: int, group: int = 0, least: int = 0, body: str | None = None) -> DataFrame:
    """Add ``out``: the spans of the pattern's matches (and, as ``body``, the matches)."""
    matches, values, gaps = f"{out}_all", f"{out}_values", f"{out}_gaps"
    df = df.withColumn(matches, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))
    some = F.size(matches) > 0
    df = df.withColumn(gaps, F.when(some, F.split(text, pattern, -1)))
    df = df.withColumn(values, F.when(some, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(group)) if group else F.col(matches)))
    kept = f"length(`{values}`[i]) >= {least}"
    span = f"named_struct('start', s.at + length(`{gaps}`[i]), 'rank', {rank}, 'stop', s.at + length(`{gaps}`[i]) + length(`{matches}`[i]), 'kind', '{kind}')"
    fold = (
        f"aggregate(sequence(0, size(`{matches}`) - 1), named_struct('at', 0, 'spans', cast(array() as {NONE})), "
        f"(s, i) -> named_struct('at', s.at + length(`{gaps}`[i]) + length(`{matches}`[i]), "
        f"'spans', if({kept}, array_append(s.spans, {span}), s.spans)), s -> s.spans)"
    )
    df = df.withColumn(out, F.when(some, F.expr(fold)).otherwise(F.expr(f"cast(array() as {NONE})")))
    return df.withColumnRenamed(matches, body).drop(values, gaps) if body else df.drop(matches, values, gaps)


def _blanked(text: str, least: int, blanked: dict[int, str]) -> Column:
    """The text with blanks in place of allowed parts, or nothing where it has no candidate."""
    found = F.col(text)
    for length, pattern in blanked.items():
        found = F.regexp_replace(found, pattern, " " * length)
    found = F.regexp_replace(found, rf"([{EQUAL_CHARACTERS}])\1{{{EQUAL - 1}}}", " " * EQUAL)
    return F.when(F.col(text).rlike(f"[{EQUAL_CHARACTERS}]{{{least}}}"), found).otherwise(F.lit(""))


def _over(kind: EntropyClass, candidate: str) -> str:
    """SQL for whether one of a candidate's windows is over the limit.

    In the state, ``n`` holds the count of each character of the alphabet in the window and
    ``sum`` the sum of c * log2(c).
    """
    w = kind.window
    # log2(w) - sum / w > bits
    limit = f"({w}D * (log2({w}D) - {kind.bits}D))"
    plog = f"array({', '.join('0D' if c < 2 else f'{c}D * log2({c}D)' for c in range(w + 2))})"
    chars = f"split({'lower(' + candidate + ')' if kind.fold else candidate}, '')"
    place = f"transform(slice({chars}, 1, length({candidate})), ch -> instr('{kind.alphabet}', ch))"
    # a character comes in at i (1-based) and one goes out at i - w
    come, go = "element_at(k.p, i)", f"if(i > {w}, element_at(k.p, i - {w}), 0)"
    count_in, count_out = f"element_at(s.n, {come})", f"element_at(s.n, {go})"
    added = f"element_at(k.g, {count_in} + 2) - element_at(k.g, {count_in} + 1)"
    taken = f"element_at(k.g, {count_out}) - element_at(k.g, {count_out} + 1)"
    # when the same character comes and goes, the counts stay
    change = f"if({come} = {go}, 0D, {added} + if({go} = 0, 0D, {taken}))"
    counts = f"if({come} = {go}, s.n, transform(s.n, (c, j) -> c + if(j + 1 = {come}, 1, 0) - if(j + 1 = {go}, 1, 0)))"
    # after the first hit nothing has to be counted any more
    step = f"if(s.hit, s, named_struct('n', {counts}, 'sum', s.sum + {change}, 'hit', i >= {w} AND s.sum + {change} < {limit}))"
    begin = f"named_struct('n', array_repeat(0, {len(kind.alphabet)}), 'sum', 0D, 'hit', false)"
    # the places and the logarithms are made once a candidate
    return f"element_at(transform(array(named_struct('p', {place}, 'g', {plog})), k -> aggregate(sequence(1, size(k.p)), {begin}, (s, i) -> {step}, s -> s.hit)), 1)"


def scan(
    df: DataFrame, text: str = "text", out: str = "__secret_spans", patterns: tuple[Pattern, ...] = PATTERNS, classes: tuple[EntropyClass, ...] = CLASSES,
    allow: tuple[str, ...] = ALLOW, blanked: dict[int, str] = BLANKED,
) -> DataFrame:
    """``df`` with ``__secret_base`` (spans of the patterns) and ``out`` (all spans), sorted."""
    df = df.withColumn("__secret_text", F.coalesce(F.col(text), F.lit("")))
    base = []
    for rank, p in enumerate(patterns):
        base.append(f"__secret_{p.kind}")
        df = _located(df, "__secret_text", p.pattern, base[-1], p.kind, rank, p.group, p.least)
    df = df.withColumn("__secret_base", F.array_sort(F.concat(*base)) if base else F.expr(f"cast(array() as {NONE})")).drop(*base)
    added = []
    if classes:
        df = df.withColumn("__secret_blanked", _blanked("__secret_text", min(c.window for c in classes), blanked))
    for rank, kind in enumerate(classes, start=len(patterns)):
        runs, places = f"__secret_{kind.kind}_runs", f"__secret_{kind.kind}_at"
        pattern = f"(?<![{kind.characters}])[{kind.characters}]{{{kind.window},}}+"
        df = _located(df, "__secret_blanked", pattern, places, kind.kind, rank, body=runs)
        allowed = " OR ".join(f"c.run rlike r'{a}'" for a in allow) or "false"
        pairs = f"zip_with(`{runs}`, `{places}`, (run, a) -> named_struct('run', run, 'span', a))"
        found = f"transform(filter({pairs}, c -> NOT ({allowed}) AND {_over(kind, 'c.run')}), c -> c.span)"
        added.append(f"__secret_{kind.kind}")
        df = df.withColumn(added[-1], F.when(F.size(runs) > 0, F.expr(found)).otherwise(F.expr(f"cast(array() as {NONE})")))
        df = df.drop(runs, places)
    if added:
        df = df.drop("__secret_blanked")
        extra = F.concat(*added)
        inside = F.filter(extra, lambda a: ~F.exists("__secret_base", lambda b: (b["start"] <= a["start"]) & (a["stop"] <= b["stop"])))
        df = df.withColumn(out, F.array_sort(F.concat(F.col("__secret_base"), inside))).drop(*added)
    else:
        df = df.withColumn(out, F.col("__secret_base"))
    return df.drop("__secret_text")


def listed(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redacted(text: str, spans: str, mark: str = "[SECRET]") -> Column:
    """The text with each span, or run of overlapping spans, replaced by ``mark``."""
    fold = (
        f"aggregate(`{spans}`, named_struct('at', 0, 'out', ''), (s, x) -> if(x.stop <= s.at, s, named_struct('at', x.stop, 'out', "
        f"if(x.start < s.at, s.out, concat(s.out, substring(`{text}`, s.at + 1, x.start - s.at), '{mark}')))), "
        f"s -> concat(s.out, substring(`{text}`, s.at + 1)))"
    )
    return F.when(F.size(spans) > 0, F.expr(fold)).otherwise(F.col(text))
