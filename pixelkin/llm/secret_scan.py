"""Secret scan: fixed patterns, and a battery of randomness tests on what else looks encoded.

Fixed patterns find assignments, access keys and hexadecimal runs. Beyond them, every run of 20 or more letters of the
usual encodings that mixes digits with letters is a candidate. Its encoding is inferred from the letters it uses, and
three tests ask whether it could be random in that alphabet: chi-squared for uniform letters, runs about the median letter,
and the correlation of neighbours. Their p-values are combined by Fisher's method. How much three tests can tell
depends on the length, so candidates are judged among those of like length: the Benjamini-Hochberg rule at level
``Q`` dismisses the ones that are not random.

A short run may pass for lack of evidence. So what remains is reported as ``random`` only where the same rule, at the same
level and by length class, also rejects that the run is made of words. Words are a chain of letter kinds (digit, lower
case, upper case, sign) that seldom changes, with the usual frequencies of letters. The likelihood ratio of random letters
to this chain exceeds t with probability at most 1 / t among words, so its inverse is a p-value, times the number of
encodings for the choice among them. This bounds the share of names among the reports.

Both rules need ranks of p-values over the whole corpus. They are counted on a grid of p (rounded up, which only keeps the
level), so the corpus is reduced to at most one row for each length class and grid step.

A ``=`` ends a run unless it pads its end, so the value of NAME=value is a candidate of its own. A run that mixes the two
alphabets of base 64 fits no encoding; it is tested in their union, and so is each part of 20 or more letters between
its ``-`` and ``_``, and between its ``+`` and ``/``. What remains of these is reported as one span where it overlaps.
Groups of hexadecimal digits between ``-``, such as a UUID, are tested as the digits alone.

All of it is DataFrame functions. Positions come from the pieces between the matches; running sums are taken in two
levels, so that a text with very many matches stays affordable.

Defined results: null is the empty text, without spans; equal rows are scanned row by row; an empty table gives an empty
one; other columns pass through ``scanned``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelkin.session import materialize

#: Patterns and least lengths (fixed values); the length rule of ``assign`` is on its second group.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
_PADDING = "(?:=+(?![A-Za-z0-9+/_=-]))?"
CANDIDATE = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{20,}}{_PADDING}"
#: Parts of a candidate that mixes the alphabets of base 64.
PARTS = (rf"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{{20,}}{_PADDING}", rf"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{{20,}}{_PADDING}")
#: Level of the rule, and steps of p by decade with the last decade counted.
Q, STEPS, DECADES = 0.05, 20, 40
_CHUNK = 256
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings by the letters they allow, narrowest first.
ENCODINGS = [
    ("^[0-9a-f]+(-[0-9a-f]+)+$", _DIGITS + "abcdef"),
    ("^[0-9A-F]+(-[0-9A-F]+)+$", _DIGITS + "ABCDEF"),
    ("^[0-9a-f]+$", _DIGITS + "abcdef"),
    ("^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("^[A-Z2-7]+=*$", _UPPER + "234567"),
    ("^[a-z0-9]+$", _DIGITS + _LOWER),
    ("^[A-Z0-9]+$", _DIGITS + _UPPER),
    ("^[A-Za-z0-9]+$", _DIGITS + _UPPER + _LOWER),
    ("^[A-Za-z0-9+/]+=*$", _UPPER + _LOWER + _DIGITS + "+/"),
    ("^[A-Za-z0-9_-]+=*$", _UPPER + _LOWER + _DIGITS + "-_"),
    ("^[A-Za-z0-9+/_-]+=*$", _UPPER + _LOWER + _DIGITS + "+/-_"),
]
_GROUPED = "^[0-9a-f]+(-[0-9a-f]+)+$|^[0-9A-F]+(-[0-9A-F]+)+$"
_MIXED = "[+/].*[_-]|[_-].*[+/]"
#: Letters a to z per mille of English text (fixed values), and how they and their kinds follow each other in words.
FREQUENCIES = (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1)
_SIGNS = "+/-_"
_USUAL, _CHANGE, _KINDS = 0.8, 0.3, 4
_ANY = _DIGITS + _LOWER + _UPPER + _SIGNS
_KIND_OF = [0] * 10 + [1] * 26 + [2] * 26 + [3] * 4
_IN_WORDS = [_USUAL * f / sum(FREQUENCIES) + (1 - _USUAL) / 26 for f in FREQUENCIES]
_LOG_OF = [math.log(p) for p in [0.1] * 10 + _IN_WORDS + _IN_WORDS + [0.25] * 4]


def _sum(values: Column, start: Column | None = None) -> Column:
    return F.aggregate(values, F.lit(0) if start is None else start, lambda acc, x: acc + x)


def _before(values: Column, start: Column) -> Column:
    """``start`` plus the sum of all earlier entries, for every entry."""
    return F.aggregate(
        values,
        F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")),
        lambda acc, x: F.struct((acc.at + x).alias("at"), F.array_append(acc.out, acc.at).alias("out")),
        lambda acc: acc.out,
    )


def _running(values: Column) -> Column:
    """Sum of all earlier entries for every entry, chunk by chunk."""
    parts = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _CHUNK).cast("int")),
        lambda c: F.slice(values, c * _CHUNK + 1, _CHUNK),
    )
    starts = _before(F.transform(parts, lambda part: _sum(part)), F.lit(0))
    return F.flatten(F.transform(F.arrays_zip(parts.alias("p"), starts.alias("s")), lambda x: _before(x.p, x.s)))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, hit>> of the matches of ``pattern``, in code points; null where there is none."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    both = F.transform(
        F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit")),
        lambda x: F.struct(F.length(x.gap).alias("gap"), F.length(x.hit).alias("len"), x.hit.alias("hit")),
    )
    return F.when(F.rlike(text, F.lit(pattern)), both)


def _placed(found: Column) -> Column:
    lengths = F.transform(found, lambda x: x.gap + x.len)
    return F.when(
        found.isNotNull(),
        F.transform(
            F.arrays_zip(found.alias("m"), _running(lengths).alias("at")),
            lambda x: F.struct(
                (x["at"] + x.m.gap).alias("start"), (x["at"] + x.m.gap + x.m.len).alias("end"), x.m.hit.alias("hit")
            ),
        ),
    )


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of the normal distribution, by the rational form of Abramowitz and Stegun, 26.2.17."""
    a = F.least(F.abs(z), F.lit(12.0))
    t = 1 / (1 + 0.2316419 * a)
    tail = (
        F.exp(-a * a / 2) / F.lit(2.5066282746310002)
        * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    )
    return F.greatest(F.when(z >= 0, tail).otherwise(1 - tail), F.lit(1e-30))


def _p_random(x: Column) -> Column:
    """Fisher's combined p-value that the letter numbers ``x.v`` are random among ``x.k``."""
    v, k = x.v, x.k.cast("double")
    n = F.size(v).cast("double")
    squares = F.aggregate(
        F.array_distinct(v),
        F.lit(0.0),
        lambda acc, letter: acc + F.pow(F.size(F.filter(v, lambda y: y == letter)).cast("double"), F.lit(2)),
    )
    chi = (k / n * squares - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
    high = F.size(F.filter(v, lambda y: 2 * y >= x.k)).cast("double")
    runs = 1 + F.aggregate(
        v,
        F.struct(F.get(v, F.lit(0)).alias("last"), F.lit(0.0).alias("runs")),
        lambda acc, y: F.struct(
            y.alias("last"),
            (acc.runs + F.when((2 * y >= x.k) != (2 * acc["last"] >= x.k), 1.0).otherwise(0.0)).alias("runs"),
        ),
        lambda acc: acc.runs,
    )
    spread = 2 * high * (n - high)
    deviation = F.sqrt(F.greatest(spread * (spread - n) / (n * n * (n - 1)), F.lit(1e-9)))
    run_z = (runs - (spread / n + 1)) / deviation
    mean = F.aggregate(v, F.lit(0.0), lambda acc, y: acc + y) / n
    variance = F.aggregate(v, F.lit(0.0), lambda acc, y: acc + (y - mean) * (y - mean))
    product = F.aggregate(
        v,
        F.struct(F.lit(None).cast("double").alias("last"), F.lit(0.0).alias("sum")),
        lambda acc, y: F.struct(
            (y - mean).alias("last"), (acc["sum"] + F.coalesce(acc["last"] * (y - mean), F.lit(0.0))).alias("sum")
        ),
        lambda acc: acc["sum"],
    )
    serial_z = (product / F.greatest(variance, F.lit(1e-9)) + 1 / (n - 1)) * F.sqrt(n)
    two_sided = [F.least(2 * _upper_tail(F.abs(z)), F.lit(1.0)) for z in (run_z, serial_z)]
    half = -(F.log(_upper_tail(chi)) + F.log(two_sided[0]) + F.log(two_sided[1]))
    return F.exp(-half) * (1 + half + half * half / 2)


def _p_words(x: Column) -> Column:
    """Bound of the probability that words give letters ``x.u`` at least as likely among ``x.k`` random ones."""
    kinds, logs = F.lit(_KIND_OF), F.lit(_LOG_OF)
    stay, change = F.lit(math.log(1 - _CHANGE)), F.lit(math.log(_CHANGE / (_KINDS - 1)))
    chain = F.aggregate(
        x.u,
        F.struct(F.lit(None).cast("int").alias("kind"), F.lit(0.0).alias("sum")),
        lambda acc, y: F.struct(
            F.get(kinds, y).alias("kind"),
            (
                acc["sum"]
                + F.get(logs, y)
                + F.when(acc.kind.isNull(), math.log(1 / _KINDS)).when(acc.kind == F.get(kinds, y), stay).otherwise(change)
            ).alias("sum"),
        ),
        lambda acc: acc["sum"],
    )
    ratio = -F.size(x.u) * F.log(x.k.cast("double")) - chain
    return F.exp(F.least(F.lit(math.log(len(ENCODINGS))) - ratio, F.lit(0.0)))


def _parts(x: Column) -> Column:
    """The candidate ``x``, followed by its parts where it mixes the alphabets of base 64."""
    own = F.struct(x.start.alias("start"), x.end.alias("end"), x.hit.alias("hit"))
    inside = [
        F.transform(
            F.coalesce(_placed(matches(x.hit, pattern)), F.array().cast("array<struct<start:int,end:int,hit:string>>")),
            lambda y: F.struct((x.start + y.start).alias("start"), (x.start + y.end).alias("end"), y.hit.alias("hit")),
        )
        for pattern in PARTS
    ]
    return F.when(F.rlike(x.hit, F.lit(_MIXED)), F.array_distinct(F.concat(F.array(own), *inside))).otherwise(F.array(own))


def _coded(column: str) -> Column:
    """By candidate, what is tested of it: letter numbers ``v`` in the inferred alphabet of ``k`` and ``u`` among all letters;
    others drop out."""

    def one(x: Column) -> Column:
        bare = F.regexp_replace(x.hit, "=+$", "")
        bare = F.when(F.rlike(x.hit, F.lit(_GROUPED)), F.translate(bare, "-", "")).otherwise(bare)
        mixed = F.rlike(x.hit, F.lit("[0-9]")) & F.rlike(x.hit, F.lit("[A-Za-z]"))
        letters = k = F.lit(None)
        for pattern, alphabet in reversed(ENCODINGS):
            fits = F.rlike(x.hit, F.lit(pattern))
            letters = F.when(fits, F.lit(alphabet)).otherwise(letters)
            k = F.when(fits, F.lit(len(alphabet))).otherwise(k)
        numbers = lambda among: F.transform(F.split(bare, ""), lambda c: F.instr(among, c) - 1)
        return F.struct(
            x.start.alias("start"),
            x.end.alias("end"),
            F.when(mixed, numbers(letters)).alias("v"),
            F.when(mixed, numbers(F.lit(_ANY))).alias("u"),
            k.cast("int").alias("k"),
        )

    tested = F.transform(
        column, lambda x: F.filter(F.transform(_parts(x), one), lambda y: y.v.isNotNull() & (F.size(y.v) >= 20))
    )
    return F.filter(tested, lambda run: F.size(run) > 0)


def _length_class(n: Column) -> Column:
    return F.floor(F.log2(n.cast("double")) * 2).cast("int")


def scanned(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_base`` and ``_tested``: spans of fixed patterns, and by candidate its tests with length class and step of p."""
    text = F.coalesce(F.col("text"), F.lit(""))
    steps = docs.select(
        "*",
        matches(text, ASSIGN).alias("_m0"),
        matches(text, ACCESS).alias("_m1"),
        matches(text, HEX).alias("_m2"),
        matches(text, CANDIDATE).alias("_m3"),
    )
    steps = steps.select(*docs.columns, *(_placed(F.col(f"_m{k}")).alias(f"_p{k}") for k in range(4)))
    long_enough = F.filter("_p0", lambda x: F.length(F.regexp_extract(x.hit, ASSIGN, 2)) >= 6)
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    kinds = [
        F.coalesce(
            F.transform(spans, lambda x: F.struct(x.start.alias("start"), F.lit(kind).alias("kind"), x.end.alias("end"))),
            none,
        )
        for kind, spans in enumerate((long_enough, F.col("_p1"), F.col("_p2")))
    ]
    steps = steps.select(*docs.columns, F.array_sort(F.concat(*kinds)).alias("_base"), _coded("_p3").alias("_coded"))
    step = lambda p: F.floor(-F.log10(F.greatest(p, F.lit(10.0**-DECADES))) * STEPS).cast("int")
    tested = F.transform(
        "_coded",
        lambda run: F.transform(
            run,
            lambda x: F.struct(
                x.start.alias("start"),
                x.end.alias("end"),
                _length_class(F.size(x.v)).alias("class"),
                step(_p_random(x)).alias("step"),
                step(_p_words(x)).alias("word_step"),
            ),
        ),
    )
    return steps.select(*docs.columns, "_base", tested.alias("_tested"))


def rejection_steps(tested: DataFrame, step: str = "step") -> dict[int, int]:
    """For each length class, the step of p from which the rule rejects: that a run is random, or (``word_step``) words.

    Step s stands for p <= 10^(-s / STEPS). The result has one entry for each length class.
    """
    each = tested.select(F.explode(F.flatten("_tested")).alias("t")).select("t.class", F.col(f"t.{step}").alias("step"))
    counts = each.groupBy("class", "step").agg(F.count("*").alias("n"))
    by_class: dict[int, dict[int, int]] = {}
    # Bounded by classes times grid steps, whatever the corpus.
    for row in counts.collect():
        by_class.setdefault(row["class"], {})[row["step"]] = row["n"]
    limits = {}
    for name, steps in by_class.items():
        total, rank, limit = sum(steps.values()), 0, None
        for step in sorted(steps, reverse=True):
            rank += steps[step]
            if 10 ** (-step / STEPS) <= Q * rank / total:
                limit = step
        limits[name] = DECADES * STEPS + 1 if limit is None else limit
    return limits


def _united(spans: Column) -> Column:
    """Spans (start, end) by start, those that overlap as one."""
    bare = F.array_sort(F.transform(spans, lambda x: F.struct(x.start.alias("start"), x.end.alias("end"))))

    def add(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        wider = F.struct(last.start.alias("start"), F.greatest(last.end, x.end).alias("end"))
        met = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)).end > x.start)
        return F.when(met, F.array_append(F.slice(acc, 1, F.size(acc) - 1), wider)).otherwise(F.array_append(acc, x))

    return F.aggregate(bare, F.array().cast("array<struct<start:int,end:int>>"), add)


def _rejected(limits: dict[int, int], step: str):
    """Condition on a test: its class has a limit that its step reaches."""

    def condition(x: Column) -> Column:
        reached = F.lit(False)
        for name, limit in limits.items():
            reached = F.when(x["class"] == name, x[step] >= limit).otherwise(reached)
        return reached

    return condition


def with_spans(scanned_docs: DataFrame) -> DataFrame:
    """A frame from ``scanned``, stored, with ``_spans``: all spans by start, then kind."""
    dismissed = _rejected(rejection_steps(scanned_docs), "step")
    wordless = _rejected(rejection_steps(scanned_docs, "word_step"), "word_step")
    apart = lambda x: ~F.exists("_base", lambda b: (b.start < x.end) & (x.start < b.end))
    random = F.transform(
        F.flatten(F.transform("_tested", lambda run: _united(F.filter(run, lambda x: ~dismissed(x) & wordless(x) & apart(x))))),
        lambda x: F.struct(x.start.alias("start"), F.lit(3).alias("kind"), x.end.alias("end")),
    )
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return scanned_docs.withColumn("_spans", F.array_sort(F.concat("_base", F.coalesce(random, none))))


def written(column: str) -> Column:
    """kind:start:end of every span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(column, lambda x: F.concat_ws(":", F.get(names, x.kind), x.start, x.end)), ","
    )


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans) of every row of ``docs`` (doc_id, text)."""
    found = materialize(scanned(docs.select("doc_id", "text")).drop("text"), "secrets")
    spans = with_spans(found)
    of_kind = lambda k: F.size(F.filter("_spans", lambda x: x.kind == k)).cast("long").alias(f"n_{KINDS[k]}")
    return spans.select(
        "doc_id",
        *map(of_kind, range(4)),
        F.sha2(written("_base").cast("binary"), 256).alias("base_sha256"),
        written("_spans").alias("spans"),
    )


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of its ``text`` replaced by ``mark``; overlapping spans are replaced as one."""
    spans = with_spans(materialize(scanned(docs), "secrets"))
    cut = F.aggregate(
        "_spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, x: F.struct(
            F.greatest(acc.at, x.end).alias("at"),
            F.when(x.start < acc.at, acc.out)
            .otherwise(F.concat(acc.out, F.substring(F.col("text"), acc.at + 1, x.start - acc.at), F.lit(mark)))
            .alias("out"),
        ),
        lambda acc: F.concat(acc.out, F.substring(F.col("text"), acc.at + 1, F.length("text"))),
    )
    return spans.withColumn("text", F.when(F.size("_spans") > 0, cut).otherwise(F.col("text"))).select(*docs.columns)
