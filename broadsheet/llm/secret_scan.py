r"""Secret scan: three pattern kinds, and sliding-window Shannon entropy by character class.

Pattern kinds follow fixed expressions. For the entropy kinds every run of a
class's characters is a candidate; a window of ``window`` characters slides over
it, the count of the character that leaves and of the one that enters change by one,
and the sum of c * log2(c) is corrected by just these two terms. The
span from the first to the last window at or above the class's limit is reported.
The allow-list drops candidates that are words, identifiers, paths, host names,
UUIDs or repeats, pieces of candidates that hold a placeholder, and those inside a span that a pattern kind has
found already.

Texts and candidates of any length are scanned whole, in time proportional to their length: a
candidate in pieces of 65,536 characters that overlap by a window, matches in blocks; no pattern steps back
over a long run. Null text counts as empty and has no spans. Offsets count code points, ends are
exclusive. Repeated rows keep a row each; an empty table gives an empty result;
other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The pattern kinds in the order of a tie, with the least length of the match or of group 2.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]+)"
HEX = r"([0-9a-f]{24,})"
BASE = (("assign", ASSIGN, 2, 6), ("access", ACCESS, 1, 20), ("hex", HEX, 1, 24))


@dataclass(frozen=True)
class EntropyClass:
    """``candidate`` is a run of ``alphabet`` characters; ``limit`` in bits for a full window."""

    kind: str
    candidate: str
    alphabet: str
    window: int
    limit: float


CLASSES = (
    EntropyClass("entropy_hex", r"(?<![0-9A-Za-z])([0-9A-F]{20,}|[0-9a-f]{20,})(?![0-9A-Za-z])", "0123456789abcdefABCDEF", 20, 2.9),
    EntropyClass("entropy_base64", r"(?<![0-9A-Za-z+/_-])([0-9A-Za-z+/_-]{20,}={0,2})", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-=", 20, 3.7),
)
#: Letters of one case, or humps of a name; random letters of both cases have single small ones between capitals.
NAME = r"[a-z]?(?:[A-Z]*+[a-z]{2,}+)*+[A-Z]*+"
#: A candidate that any of these matches as a whole is no secret.
ALLOW = (
    rf"[-_/+]*+(?:{NAME}[-_/+]++)*+{NAME}=*",  # words, alone or joined by marks
    r"[-_/+]*+[0-9]++(?:[-_/+][0-9]++)*+[-_/+]*",  # numbers and dates; no group is left by stepping back, so none recurses
    r"[-_=+/]+",  # rules
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",  # UUID
)
#: A piece between marks that holds one of these is cut out of its candidate; what stands beside it is judged.
PLACEHOLDER = r"(?i:example|placeholder|changeme|xxxx|dummy|sample|abcdef|01234567|your[_-])"
BESIDE = rf"((?:(?<![0-9A-Za-z])(?![0-9A-Za-z]*{PLACEHOLDER})[0-9A-Za-z]++|[-_/+=]++)++)"
ALLOWED = r"\A(?:" + "|".join(ALLOW) + r")\z"


_SPAN = "array<struct<at:int,to:int,found:string>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once; a column named twice would be worked out twice."""
    return F.transform(F.array(value), use)[0]


def _scanned(items: Column, carry: Column, empty: Column, step: Callable[[Column, Column], tuple[Column, Column]], block: int = 256) -> Column:
    """What the steps give, one after the other: step(carry, item) is the next carry and an array. Blocks keep the copies of a growing array short."""

    def inner(acc: Column, item: Column) -> Column:
        after, new = step(acc["carry"], item)
        return F.struct(after.alias("carry"), F.concat(acc["out"], new).alias("out"))

    def outer(acc: Column, part: Column) -> Column:
        done = F.aggregate(part, F.struct(acc["carry"].alias("carry"), empty.alias("out")), inner)
        return _let(done, lambda x: F.struct(x["carry"].alias("carry"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

    def whole(v: Column) -> Column:
        last = F.greatest(F.floor((F.size(v) - 1) / block).cast("int"), F.lit(0))
        parts = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(v, k * block + 1, block))
        return F.flatten(F.aggregate(parts, F.struct(carry.alias("carry"), F.slice(F.array(empty), 1, 0).alias("out")), outer)["out"])

    return _let(items, whole)


def _matches(text: Column, pattern: str, group: int, least: int) -> Column:
    """array<struct<at, to, found>> of non-overlapping matches whose group has ``least`` characters; pieces between matches give the offsets."""
    gaps, whole, part = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    zipped = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), whole.alias("whole"), part.alias("part"))
    none = F.array().cast(_SPAN)

    def step(pos: Column, m: Column) -> tuple[Column, Column]:
        at = pos + m["gap"]
        to = at + F.coalesce(F.length(m["whole"]), F.lit(0))
        return to, F.when(F.length(m["part"]) >= least, F.array(F.struct(at.alias("at"), to.alias("to"), m["part"].alias("found")))).otherwise(none)

    return F.when(text.rlike(pattern), _scanned(zipped, F.lit(0), none, step)).otherwise(none)


def _outside(candidates: Column, known: Column) -> Column:
    """The candidates that no known span holds: in order of their starts, those that end behind every known span begun so far."""
    ranked = lambda spans, rank: F.transform(spans, lambda x: F.struct(x["at"].alias("at"), F.lit(rank).alias("rank"), x["to"].alias("to"), x["found"].alias("found")))
    none = F.array().cast(_SPAN)

    def step(reach: Column, x: Column) -> tuple[Column, Column]:
        free = (x["rank"] == 1) & (x["to"] > reach)
        return F.when(x["rank"] == 0, F.greatest(reach, x["to"])).otherwise(reach), F.when(free, F.array(F.struct(x["at"].alias("at"), x["to"].alias("to"), x["found"].alias("found")))).otherwise(none)

    return _scanned(F.sort_array(F.concat(ranked(known, 0), ranked(candidates, 1))), F.lit(-1), none, step)


#: Characters of a candidate that are held as an array at once.
_CHARS = 1 << 16


def _hot(found: Column, c: EntropyClass) -> Column:
    """struct<first, last> of the windows at or above the limit (0-based starts), nulls if none.

    State: the counts by character of the alphabet, some to a long, and s = sum of count * log2(count). A
    step adds one to the count of the character that enters and takes one from that which leaves; s changes
    by what these two counts give. A long candidate is taken in pieces that overlap by a window less one character.
    """
    bits = c.window.bit_length()
    each = 62 // bits
    n_longs = -(-len(c.alphabet) // each)
    place = [c.alphabet.find(chr(i)) for i in range(128)]
    # by character: which long holds its count, from which bit on, and a count of one there
    table = F.array(*[F.struct(F.lit(i // each).alias("long"), F.lit(i % each * bits).alias("bit"), F.lit(1 << i % each * bits).cast("long").alias("one")) for i in place])
    plogp = [n * math.log2(n) if n else 0.0 for n in range(c.window + 2)]
    more = F.lit([b - a for a, b in zip(plogp, plogp[1:], strict=False)])  # from n to n + 1
    zero = F.struct(F.array_repeat(F.lit(0).cast("long"), n_longs).alias("counts"), F.lit(0.0).alias("s"), F.lit(1 - c.window).alias("begin"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))
    most = c.window * (math.log2(c.window) - c.limit)  # s of a window at the limit

    def count(acc: Column, x: Column) -> Column:
        return F.call_function("shiftright", acc["counts"][x["long"]], x["bit"]).bitwiseAND(F.lit((1 << bits) - 1).cast("long")).cast("int")

    def slide(acc: Column, x: Column) -> Column:
        enters, leaves, begin = x["enters"], x["leaves"], acc["begin"]
        # the one that leaves has gone when the other enters
        here = count(acc, enters) - F.when(leaves["one"] == enters["one"], F.when(leaves["long"] == enters["long"], 1).otherwise(0)).otherwise(0)
        s = acc["s"] - F.when(leaves["one"] > 0, more[count(acc, leaves) - 1]).otherwise(F.lit(0.0)) + more[here]
        counts = F.transform(acc["counts"], lambda v, k: v + F.when(k == enters["long"], enters["one"]).otherwise(F.lit(0).cast("long")) - F.when(k == leaves["long"], leaves["one"]).otherwise(F.lit(0).cast("long")))
        return F.struct(counts.alias("counts"), s.alias("s"), begin.alias("begin"), acc["first"].alias("first"), acc["last"].alias("last"))

    def judge(x: Column) -> Column:
        high = (x["begin"] >= 0) & (x["s"] <= F.lit(most + 1e-9))
        return F.struct(x["counts"].alias("counts"), x["s"].alias("s"), (x["begin"] + 1).alias("begin"), F.when(high, F.coalesce(x["first"], x["begin"])).otherwise(x["first"]).alias("first"), F.when(high, x["begin"]).otherwise(x["last"]).alias("last"))

    def piece(k: Column) -> Column:
        at = k * _CHARS
        chars = F.transform(F.split(F.substring(found, at + 1, F.lit(_CHARS + c.window - 1)), ""), lambda x: table[F.ascii(x)])
        nothing = F.array_repeat(F.struct(F.lit(0).alias("long"), F.lit(0).alias("bit"), F.lit(0).cast("long").alias("one")), c.window)
        moves = lambda v: F.zip_with(v, F.slice(F.concat(nothing, v), 1, F.size(v)), lambda a, b: F.struct(a.alias("enters"), b.alias("leaves")))
        return _let(F.aggregate(_let(chars, moves), zero, lambda acc, x: _let(slide(acc, x), judge)), lambda x: F.struct((x["first"] + at).alias("first"), (x["last"] + at).alias("last")))

    last = F.greatest(F.floor((F.length(found) - c.window) / _CHARS).cast("int"), F.lit(0))
    pieces = F.transform(F.sequence(F.lit(0), last), piece)
    return _let(pieces, lambda x: F.struct(F.array_min(F.transform(x, lambda y: y["first"])).alias("first"), F.array_max(F.transform(x, lambda y: y["last"])).alias("last")))


def secret_spans(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` plus one array of struct<at, rank, to, kind> for each kind."""
    t = F.coalesce(F.col(text), F.lit(""))
    named = docs.select(*keep, t.alias("__text"))
    mark = lambda spans, kind, rank: F.transform(spans, lambda x: F.struct(x["at"].alias("at"), F.lit(rank).alias("rank"), x["to"].alias("to"), F.lit(kind).alias("kind")))
    kinds = [kind for kind, *_ in BASE] + [c.kind for c in CLASSES]
    out = named.select(*keep, *[_matches(F.col("__text"), p, g, n).alias(f"__{kind}") for kind, p, g, n in BASE], *[_matches(F.col("__text"), c.candidate, 1, c.window).alias(f"__{c.kind}") for c in CLASSES])
    known = F.concat(*[F.col(f"__{kind}") for kind, *_ in BASE])
    out = out.withColumn("__known", known)
    for c in CLASSES:
        # once for each candidate; those without a placeholder stay as they are
        beside = lambda x: F.when(x["found"].rlike(PLACEHOLDER), F.transform(_matches(x["found"], BESIDE, 1, c.window), lambda y: F.struct((x["at"] + y["at"]).alias("at"), (x["at"] + y["to"]).alias("to"), y["found"].alias("found")))).otherwise(F.array(x))  # noqa: E731, B023
        out = out.withColumn(f"__{c.kind}", F.when(F.exists(F.col(f"__{c.kind}"), lambda x: x["found"].rlike(PLACEHOLDER)), F.flatten(F.transform(F.col(f"__{c.kind}"), beside))).otherwise(F.col(f"__{c.kind}")))
        own = F.col(f"__{c.kind}")
        out = out.withColumn(f"__{c.kind}", F.when(F.size(own) > 0, F.filter(own, lambda x: ~x["found"].rlike(ALLOWED))).otherwise(own))
        out = out.withColumn(f"__{c.kind}", F.when((F.size(own) > 0) & (F.size("__known") > 0), _outside(own, F.col("__known"))).otherwise(own))
        hot = F.transform(F.col(f"__{c.kind}"), lambda x: F.struct(x["at"].alias("at"), _hot(x["found"], c).alias("h")))  # noqa: B023
        out = out.withColumn(f"__{c.kind}", F.when(F.size(f"__{c.kind}") > 0, hot).otherwise(F.array().cast("array<struct<at:int,h:struct<first:int,last:int>>>")))
        spans = F.transform(F.filter(F.col(f"__{c.kind}"), lambda x: x["h"]["first"].isNotNull()), lambda x: F.struct((x["at"] + x["h"]["first"]).alias("at"), (x["at"] + x["h"]["last"] + c.window).alias("to"), F.lit(None).cast("string").alias("found")))  # noqa: B023
        out = out.withColumn(f"__{c.kind}", spans)
    return out.select(*keep, *[mark(F.col(f"__{kind}"), kind, i).alias(kind) for i, kind in enumerate(kinds)])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(":", x["kind"], x["at"].cast("string"), x["to"].cast("string"))), ",")


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans."""
    found = secret_spans(docs, ["doc_id"])
    base = F.concat(*[F.col(kind) for kind, *_ in BASE])
    extra = [F.col(c.kind) for c in CLASSES]
    return found.select(
        "doc_id",
        *[F.size(kind).cast("long").alias(f"n_{kind}") for kind, *_ in BASE],
        sum((F.size(x) for x in extra), F.lit(0)).cast("long").alias("n_entropy"),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.concat(base, *extra)).alias("spans"),
    )
