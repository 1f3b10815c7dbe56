"""Secrets in texts: fixed patterns, and runs of characters that look drawn at random."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipscore.llm.common import DOCUMENT_COLUMNS, let, text_of

# Fixed values of the contract: kinds in order, their patterns, the shortest length that counts.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy")

SPAN = "array<struct<start:int,kind:int,stop:int>>"
RUN = "array<struct<start:int,kind:int,stop:int,run:string>>"


@dataclass(frozen=True)
class CharClass:
    """A character class, its regular-expression set, and the bits per character a window must exceed."""

    alphabet: str
    chars: str
    bits: float


@dataclass(frozen=True)
class EntropyRule:
    """``window`` characters at a time; runs matching an ``allowed`` expression are no secrets."""

    window: int = 24
    classes: tuple[CharClass, ...] = (
        CharClass("0123456789abcdefABCDEF", "0-9a-fA-F", 3.2),
        CharClass("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-", "A-Za-z0-9+/=_-", 3.9),
    )
    allowed: tuple[str, ...] = field(
        default=(
            "(?i)example",  # keys of documentation
            "(?i)abcdefghijkl",  # alphabets spelt out
            "(?i)0123456789abcdef",
            "^[a-z/_=+-]+$",  # words, paths and rules: no digit and no capital
            "^[A-Z/_=+-]+$",
        )
    )


def _empty(kind: str = SPAN) -> Column:
    return F.array().cast(kind)


_BLOCK = 256


def _collected(items: Column, state: dict[str, Column], step, last, kind: str) -> Column:
    """Fold ``items`` and collect what ``step`` gives out.

    ``step(state, item)`` returns (next fields of the state, array to give out), ``last(state)`` one more array.  A
    fold copies all it holds at every item, so it must not hold the output: a first fold over blocks keeps
    the states at their starts alone, then every block collects its own output from there.
    """
    zero = F.struct(*[v.alias(k) for k, v in state.items()])
    moved = lambda s, x: F.struct(*[v.alias(k) for k, v in step(s, x)[0].items()])

    def in_blocks(xs):
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / _BLOCK).cast("int")), lambda b: F.slice(xs, b * _BLOCK + 1, F.lit(_BLOCK)))

        def gathered(blocks):
            begin = F.struct(zero.alias("now"), F.slice(F.array(zero), 1, 0).alias("starts"))
            starts = F.aggregate(
                blocks, begin,
                lambda a, block: F.struct(F.aggregate(block, a["now"], moved).alias("now"), F.concat(a["starts"], F.array(a["now"])).alias("starts")),
            )

            def out_of(block, first):
                def both(a, x):
                    fields, out = step(a["now"], x)
                    return F.struct(F.struct(*[v.alias(k) for k, v in fields.items()]).alias("now"), F.concat(a["out"], out).alias("out"))

                return F.aggregate(block, F.struct(first.alias("now"), _empty(kind).alias("out")), both, lambda a: a["out"])

            def ended(found):
                return F.concat(F.flatten(F.zip_with(blocks, found["starts"], out_of)), last(found["now"]))

            return let(starts, ended)

        return F.when(F.size(xs) == 0, last(zero)).otherwise(let(cut, gathered))

    return let(items, in_blocks)


def _located(text: Column, pattern: str, kind: int, keep, run: bool = False) -> Column:
    """Spans, in code points, of the matches that ``keep`` accepts; with ``run`` the matches too.

    The pieces between the matches are the split by the same pattern; running lengths of pieces and
    matches are the positions.
    """
    made = RUN if run else SPAN

    def walk(found):
        steps = F.zip_with(F.split(text, pattern, -1), found, lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("hit")))

        def step(state, x):
            begin = state["at"] + x["gap"]
            end = begin + F.coalesce(F.length(x["hit"]), F.lit(0))
            fields = [begin.alias("start"), F.lit(kind).alias("kind"), end.alias("stop")]
            span = F.array(F.struct(*fields, *([x["hit"].alias("run")] if run else [])))
            return {"at": end}, F.when(x["hit"].isNotNull() & keep(x["hit"]), span).otherwise(_empty(made))

        spans = _collected(steps, {"at": F.lit(0)}, step, lambda s: _empty(made), made)
        return F.when(F.size(found) == 0, _empty(made)).otherwise(spans)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), walk)


def base_spans(text: Column) -> Column:
    """The three fixed kinds, by start, then kind."""
    return F.array_sort(
        F.concat(
            _located(text, ASSIGN, 0, lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 2)) >= 8),
            _located(text, ACCESS, 1, lambda hit: F.lit(True)),
            _located(text, HEX, 2, lambda hit: F.lit(True)),
        )
    )


def least_log_sum(run: Column, alphabet: str, window: int) -> Column:
    """The least sum of c * log2(c) over the windows of a run, c counting each character, in millionths.

    The run becomes numbers of its characters once.  Then one step per character: the counts gain the
    character that enters and lose the one that leaves, and the sum changes by their two terms alone.
    Whole numbers, so nothing drifts.
    """
    terms = F.array(*[F.lit(round(c * math.log2(c) * 1e6) if c else 0) for c in range(window + 1)])
    zero = F.array_repeat(F.lit(0), len(alphabet))
    start = F.struct(zero.alias("counts"), F.lit(0).alias("total"), F.lit(2**31 - 1).alias("least"))

    def walked(symbols):
        def step(state, i):
            def moved(bounds):
                enters, leaves = bounds["enters"], bounds["leaves"]
                gain = F.when(enters == leaves, 0).otherwise(terms[state["counts"][enters] + 1] - terms[state["counts"][enters]])
                loss = F.when((leaves < 0) | (enters == leaves), 0).otherwise(terms[state["counts"][F.greatest(leaves, F.lit(0))]] - terms[F.greatest(state["counts"][F.greatest(leaves, F.lit(0))] - 1, F.lit(0))])
                counts = F.transform(state["counts"], lambda c, j: c + (j == enters).cast("int") - (j == leaves).cast("int"))
                total = state["total"] + gain - loss
                least = F.when(i >= window, F.least(state["least"], total)).otherwise(state["least"])
                return F.struct(counts.alias("counts"), total.alias("total"), least.alias("least"))

            leaves = F.when(i > window, F.get(symbols, i - window - 1)).otherwise(-1)
            return let(F.struct(F.get(symbols, i - 1).alias("enters"), leaves.alias("leaves")), moved)

        return F.aggregate(F.sequence(F.lit(1), F.size(symbols)), start, step, lambda s: s["least"])

    return let(F.transform(F.split(run, ""), lambda c: F.instr(F.lit(alphabet), c) - 1), walked)


def _clear(runs: Column, base: Column) -> Column:
    """The runs (disjoint) that no base span touches: one walk over both in order of their starts."""
    plain = F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["stop"].alias("stop"), F.lit("").alias("run")))
    none = F.lit(None).cast(RUN[len("array<") : -1])
    held = lambda s: F.when(s["open"].isNull(), _empty(RUN)).otherwise(F.array(s["open"]))

    def step(s, x):
        is_base = x["kind"] < 3
        touched = is_base & (x["start"] < s["open"]["stop"])
        now = F.when(is_base, F.when(touched, none).otherwise(s["open"])).otherwise(F.when(s["reach"] > x["start"], none).otherwise(x))
        reach = F.when(is_base, F.greatest(s["reach"], x["stop"])).otherwise(s["reach"])
        return {"reach": reach, "open": now}, F.when(is_base, _empty(RUN)).otherwise(held(s))

    walk = _collected(F.array_sort(F.concat(plain, runs)), {"reach": F.lit(0), "open": none}, step, held, RUN)
    return F.when((F.size(base) == 0) | (F.size(runs) == 0), runs).otherwise(walk)


def _entropy_spans(text: Column, base: Column, rule: EntropyRule) -> Column:
    """Runs of one character class with a window above the class's bits, clear of base spans and allowed forms."""

    def of_class(one: CharClass) -> Column:
        most = round(rule.window * (math.log2(rule.window) - one.bits) * 1e6)

        def suspicious(run):
            allowed = F.lit(False)
            for pattern in rule.allowed:
                allowed = allowed | run.rlike(pattern)
            return ~allowed & (least_log_sum(run, one.alphabet, rule.window) < most)

        runs = _located(text, f"[{one.chars}]{{{rule.window},}}", 3, lambda hit: F.lit(True), run=True)
        return F.filter(let(runs, lambda r: _clear(r, base)), lambda s: suspicious(s["run"]))

    # As one long a span, which sorts and compares by hash.
    longs = F.transform(F.concat(*map(of_class, rule.classes)), lambda s: F.shiftleft(s["start"].cast("bigint"), 31) + s["stop"])
    span = lambda x: F.struct(F.shiftright(x, 31).cast("int").alias("start"), F.lit(3).alias("kind"), x.bitwiseAND(F.lit((1 << 31) - 1)).cast("int").alias("stop"))
    return F.transform(F.array_sort(F.array_distinct(longs)), span)


def _joined(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"], s["stop"])))


def with_spans(docs: DataFrame, rule: EntropyRule) -> DataFrame:
    """``base`` and ``added`` spans beside the columns."""
    text = text_of()
    return docs.withColumn("base", base_spans(text)).withColumn("added", _entropy_spans(text, F.col("base"), rule))


def scan(docs: DataFrame, rule: EntropyRule = EntropyRule()) -> DataFrame:
    """Secrets per document: doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans.

    ``spans`` lists kind:start:end (code points, end exclusive) by start, then kind.  Entropy spans
    never touch a base span.  Null and empty texts have no spans; repeated rows each get their row; an
    empty table gives an empty one; other columns are not looked at.
    """
    found = with_spans(docs.select("doc_id", "text"), rule)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{KINDS[kind]}")
    return found.select(
        "doc_id", count(0), count(1), count(2), F.size("added").cast("bigint").alias("n_entropy"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


def redact(docs: DataFrame, rule: EntropyRule = EntropyRule(), mark: str = "[SECRET]") -> DataFrame:
    """The documents with each stretch of overlapping spans replaced by ``mark``; ``n_chars`` follows the text.

    Documents without a span stay as they are (null texts too); repeated rows each stay, an empty table gives an
    empty one.  Keeps the columns of documents only, so further columns, whatever their names, go.
    """
    found = with_spans(docs.select(*DOCUMENT_COLUMNS), rule)

    def cleaned(chars):
        piece = lambda a, b: F.array(F.array_join(F.slice(chars, a + 1, b - a), ""))

        def step(state, s):
            apart = s["start"] >= state["at"]
            out = F.when(apart, F.concat(piece(state["at"], s["start"]), F.array(F.lit(mark)))).otherwise(_empty("array<string>"))
            return {"at": F.greatest(state["at"], s["stop"])}, out

        spans = F.array_sort(F.concat("base", "added"))
        pieces = _collected(spans, {"at": F.lit(0)}, step, lambda s: piece(s["at"], F.greatest(F.size(chars), s["at"])), "array<string>")
        return F.array_join(pieces, "")

    clean = let(F.regexp_extract_all("text", F.lit("(?s)."), F.lit(0)), cleaned)
    hit = F.size("base") + F.size("added") > 0
    out = found.withColumn("text", F.when(hit, clean).otherwise(F.col("text")))
    return out.withColumn("n_chars", F.when(hit, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*DOCUMENT_COLUMNS)
