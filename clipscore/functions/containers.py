"""Container header checks as Column expressions over file bytes; audio is never decoded.

Only slices of the content are touched, so nothing leaves the JVM.  The WAV walk visits chunk
headers with a fold whose step count is the square root of the largest possible chunk number,
nested twice: exact for any file, a few thousand cheap steps at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipscore.functions.vectors import let

# Magic bytes and header limits.
FIRST_BYTES = 64
ASF = "3026B2758E66CF11A6D900AA0062CE6C"
PREFIX_RULES = (
    # suffix, zero-based offset, accepted hex texts, what was checked
    (".ogg", 0, ("4F67675300",), "Ogg page"),
    (".opus", 0, ("4F67675300",), "Ogg page"),
    (".aif", 0, ("464F524D",), "AIFF form"),
    (".aif", 8, ("41494646", "41494643"), "AIFF form"),
    (".aiff", 0, ("464F524D",), "AIFF form"),
    (".aiff", 8, ("41494646", "41494643"), "AIFF form"),
    (".webm", 0, ("1A45DFA3",), "EBML header"),
    (".wma", 0, (ASF,), "ASF header"),
)
MAX_CHANNELS, MAX_RATE, MIN_WAV = 32, 768_000, 44


def bytes_at(content: Column, offset: Column | int, n: int) -> Column:
    offset = offset if isinstance(offset, Column) else F.lit(offset)
    return F.substring(content, (offset + 1).cast("int"), F.lit(n))


def hex_at(content: Column, offset: Column | int, n: int) -> Column:
    return F.hex(bytes_at(content, offset, n))


def big_endian(content: Column, offset: Column | int, n: int) -> Column:
    """Unsigned integer of up to 7 bytes; null past the end."""
    text = hex_at(content, offset, n)
    return F.when(F.length(text) == 2 * n, F.conv(text, 16, 10).cast("long"))


def little_endian(content: Column, offset: Column | int, n: int) -> Column:
    text = hex_at(content, offset, n)
    swapped = F.concat(*[F.substring(text, 2 * i + 1, 2) for i in reversed(range(n))])
    return F.when(F.length(text) == 2 * n, F.conv(swapped, 16, 10).cast("long"))


def _first_problem(rules: list[tuple[Column, str]]) -> Column:
    """Text of the first broken rule; a rule that cannot be evaluated counts as broken."""
    out = F.lit(None).cast("string")
    for bad, text in reversed(rules):
        out = F.when(F.coalesce(bad, F.lit(True)), text).otherwise(out)
    return out


STATE = "struct<pos:bigint,problem:string,fmt:bigint,data:bigint>"


def _walk(content: Column, end: Column) -> Column:
    """Fold over RIFF chunks: where the walk stopped, the format chunk and the summed data size."""

    def advance(s: Column, chunk: Column) -> Column:
        pos, kind, size = s["pos"], F.substring(chunk, 1, 8), chunk_size(chunk)
        return let(
            F.struct(kind.alias("kind"), size.alias("size"), (pos + 8 + size + size % 2).alias("next")),
            lambda c: F.struct(
                F.coalesce(c["next"], pos).alias("pos"),
                F.when(c["size"].isNull(), "chunk header is cut off")
                .when(c["next"] > end, "chunk runs past the declared RIFF size")
                .when((c["kind"] == "666D7420") & (c["size"] < 16), "format chunk is too short")
                .alias("problem"),
                F.when(c["kind"] == "666D7420", pos + 8).otherwise(s["fmt"]).alias("fmt"),
                F.when(
                    c["kind"] == "64617461", F.coalesce(s["data"], F.lit(0).cast("long")) + c["size"]
                )
                .otherwise(s["data"])
                .alias("data"),
            ),
        )

    def stopped(s: Column) -> Column:
        return s["problem"].isNotNull() | (s["pos"] + 8 > end)

    def step(s: Column, _: Column) -> Column:
        moved = let(hex_at(content, s["pos"], 8), lambda chunk: advance(s, chunk))
        return F.when(stopped(s), s).otherwise(moved).cast(STATE)

    start = F.struct(
        F.lit(12).cast("long").alias("pos"),
        F.lit(None).cast("string").alias("problem"),
        F.lit(None).cast("long").alias("fmt"),
        F.lit(None).cast("long").alias("data"),
    ).cast(STATE)
    side = F.ceil(F.sqrt(F.greatest(end, F.lit(8)) / 8.0)).cast("int") + 1

    def row(s: Column, _: Column) -> Column:
        inner = F.aggregate(F.sequence(F.lit(1), side), s, step)
        return F.when(stopped(s), s).otherwise(inner).cast(STATE)

    return F.aggregate(F.sequence(F.lit(1), side), start, row)


def chunk_size(chunk: Column) -> Column:
    """Little-endian size in the last four of eight chunk-header bytes given as hex text."""
    swapped = F.concat(*[F.substring(chunk, 9 + 2 * i, 2) for i in reversed(range(4))])
    return F.when(F.length(chunk) == 16, F.conv(swapped, 16, 10).cast("long"))


def with_wav_walk(df: DataFrame, content: str = "content", size: str = "length") -> DataFrame:
    """Add ``_riff`` (declared end and magic) and ``_wav`` (walk result and format fields), each
    computed once per file and read by ``wav_verdict`` and ``wav_facts``."""
    c = F.col(content)
    head = F.struct(
        hex_at(c, 0, 4).alias("head"),
        hex_at(c, 8, 4).alias("kind"),
        (little_endian(c, 4, 4) + 8).alias("end"),
    )
    usable = (F.col("_riff.head") == "52494646") & (F.col("_riff.kind") == "57415645")
    reach = F.least(F.col("_riff.end"), F.col(size))
    rows = df.withColumn("_riff", head)
    rows = rows.withColumn("_walk", F.when(usable, _walk(c, reach)))
    rows = rows.withColumn("_f", F.hex(bytes_at(c, F.col("_walk.fmt"), 16)))

    def field(offset: int, n: int) -> Column:
        pairs = [F.substring("_f", 2 * (offset + i) + 1, 2) for i in reversed(range(n))]
        return F.when(F.length("_f") == 32, F.conv(F.concat(*pairs), 16, 10).cast("long"))

    return rows.withColumn(
        "_wav",
        F.struct(
            "_walk.pos",
            "_walk.problem",
            "_walk.fmt",
            "_walk.data",
            field(0, 2).alias("code"),
            field(2, 2).alias("channels"),
            field(4, 4).alias("rate"),
            field(8, 4).alias("byte_rate"),
            field(12, 2).alias("align"),
            field(14, 2).alias("bits"),
        ),
    ).drop("_walk", "_f")


def wav_problem(size: Column) -> Column:
    """RIFF/WAVE rules: declared size, chunk boundaries, a format chunk and some data, and for
    integer or float PCM agreeing sample width, alignment and rates."""
    head, kind, end = (F.col(f"_riff.{n}") for n in ("head", "kind", "end"))
    at, data, code, channels, rate, byte_rate, align, bits = (
        F.col(f"_wav.{n}")
        for n in ("fmt", "data", "code", "channels", "rate", "byte_rate", "align", "bits")
    )
    pcm = code.isin(1, 3)
    before = _first_problem(
        [
            ((head != "52494646") | (kind != "57415645"), "not a RIFF/WAVE header"),
            (end > size, "RIFF size is larger than the file"),
            (end < MIN_WAV, "RIFF size is too small for audio"),
        ]
    )
    after = _first_problem(
        [
            (F.col("_wav.pos") != end, "chunks do not end at the RIFF size"),
            (at.isNull() | data.isNull() | (data == 0), "format or data chunk missing"),
            (
                ~channels.between(1, MAX_CHANNELS) | ~rate.between(1, MAX_RATE) | (align == 0),
                "channels, rate or alignment out of range",
            ),
            (
                pcm & ((bits == 0) | (bits % 8 != 0) | (align != channels * F.floor(bits / 8))),
                "sample width and alignment disagree",
            ),
            (pcm & (byte_rate != rate * align), "byte rate disagrees with rate and alignment"),
            (pcm & (F.try_mod(data, align) != 0), "data is not whole frames"),
        ]
    )
    return F.coalesce(before, F.col("_wav.problem"), after)


def flac_problem(content: Column, size: Column) -> Column:
    """First block is STREAMINFO of length 34 with a valid packed rate, channel count and depth."""
    packed = big_endian(content, 18, 4)  # 20 bits rate, 3 channels - 1, 5 depth - 1, 4 of length
    depth = F.shiftright(packed, 4).bitwiseAND(F.lit(31)) + 1
    return _first_problem(
        [
            (hex_at(content, 0, 4) != "664C6143", "not a FLAC header"),
            (
                (size < 42)
                | (big_endian(content, 4, 1).bitwiseAND(F.lit(127)) != 0)
                | (big_endian(content, 5, 3) != 34),
                "STREAMINFO block missing or malformed",
            ),
            ((F.shiftright(packed, 12) == 0) | (depth < 4), "STREAMINFO values out of range"),
        ]
    )


def _is_tagged(content: Column) -> Column:
    return hex_at(content, 0, 3) == "494433"


def mp3_problem(content: Column, size: Column) -> Column:
    """ID3 v2-4 tag whose sync-safe size ends inside the file, or an MPEG frame sync."""
    version = big_endian(content, 3, 1)
    b = [big_endian(content, i, 1) for i in range(6, 10)]
    tag = b[0] * 2097152 + b[1] * 16384 + b[2] * 128 + b[3]
    high = big_endian(content, 6, 4).bitwiseAND(F.lit(0x80808080)) != 0
    id3 = _first_problem(
        [
            (~version.isin(2, 3, 4) | high, "ID3 header is malformed"),
            (tag + 10 >= size, "ID3 tag runs past the file"),
        ]
    )
    sync = big_endian(content, 0, 2).bitwiseAND(F.lit(0xFFE0)) != 0xFFE0
    return F.when(_is_tagged(content), id3).otherwise(
        _first_problem([(sync, "neither ID3 nor MPEG header")])
    )


def mp4_problem(content: Column, size: Column) -> Column:
    box = big_endian(content, 0, 4)
    bad = (hex_at(content, 4, 4) != "66747970") | (box < 8) | (box > size)
    return _first_problem([(bad, "file type box missing or too large")])


def aac_problem(content: Column) -> Column:
    sync = big_endian(content, 0, 2).bitwiseAND(F.lit(0xFFF0)) != 0xFFF0
    return _first_problem([(sync, "no ADTS frame")])


def prefix_problem(content: Column, suffix: str, rules=PREFIX_RULES) -> Column:
    """All byte-prefix rules of one suffix."""
    bad = F.lit(False)
    for name, offset, texts, _ in rules:
        if name == suffix:
            bad = bad | ~hex_at(content, offset, len(texts[0]) // 2).isin(*texts)
    return _first_problem([(bad, f"the {suffix} suffix does not match the header")])


def with_verdict(
    df: DataFrame,
    content: str = "content",
    size: str = "length",
    suffix: str = "suffix",
    name: str = "container",
    rules=PREFIX_RULES,
) -> DataFrame:
    """Add struct(status, checks, inconsistencies) by lower-case suffix; unlisted suffixes are
    unknown.  The problem text is found once and the struct built from it."""
    c, n, end = F.col(content), F.col(size), F.col(suffix)
    is_wav = end.isin(".wav", ".wave")
    rows = with_wav_walk(df.withColumn("_c", F.when(is_wav, c)), "_c", size)
    variant = F.col("_riff.head").isin("52463634", "52494658") & (F.col("_riff.kind") == "57415645")
    cases = [
        (is_wav, wav_problem(n), F.lit("RIFF/WAVE chunks and PCM alignment")),
        (end == ".flac", flac_problem(c, n), F.lit("FLAC signature and STREAMINFO")),
        (
            end == ".mp3",
            mp3_problem(c, n),
            F.when(_is_tagged(c), "ID3 header and size").otherwise("MPEG frame sync"),
        ),
        (end.isin(".m4a", ".mp4"), mp4_problem(c, n), F.lit("MP4 file type box")),
        (end == ".aac", aac_problem(c), F.lit("ADTS frame")),
    ]
    for each, check in {r[0]: r[3] for r in rules}.items():
        cases.append((end == each, prefix_problem(c, each, rules), F.lit(check)))
    problem = check = F.lit(None).cast("string")
    for hit, found, checked in reversed(cases):
        problem = F.when(hit, found).otherwise(problem)
        check = F.when(hit, checked).otherwise(check)
    odd = F.coalesce(is_wav & variant, F.lit(False))
    rows = (
        rows.withColumn("_odd", odd)
        .withColumn("_problem", F.when(~F.col("_odd"), problem))
        .withColumn("_check", F.when(F.col("_odd"), "WAVE variant is not checked").otherwise(check))
    )
    status = (
        F.when(F.col("_odd") | F.col("_check").isNull(), "unknown")
        .when(F.col("_problem").isNull(), "consistent")
        .otherwise("inconsistent")
    )
    passed = F.when(F.col("_problem").isNull(), F.col("_check"))
    return rows.withColumn(
        name,
        F.struct(
            status.alias("status"),
            F.array_compact(F.array(passed)).alias("checks"),
            F.array_compact(F.array("_problem")).alias("inconsistencies"),
        ),
    ).drop("_c", "_riff", "_wav", "_odd", "_problem", "_check")


def with_wav_facts(
    df: DataFrame,
    content: str = "content",
    size: str = "length",
    suffix: str = "suffix",
    name: str = "header",
) -> DataFrame:
    """Add the seven encoding header columns of an integer-PCM WAV; for anything else the suffix
    flag, zeros and the log of the file size."""
    rows = with_wav_walk(df, content, size)
    channels, rate, bits = (F.col(f"_wav.{n}").cast("double") for n in ("channels", "rate", "bits"))
    width = F.ceil(bits / 8).cast("double")
    data = F.col("_wav.data")
    frames = F.floor(F.try_divide(data, channels * width)).cast("double")
    seconds = F.greatest(F.try_divide(frames, F.greatest(rate, F.lit(1.0))), F.lit(1e-6))
    good = F.coalesce(
        (F.col("_wav.code") == 1) & data.isNotNull() & (channels > 0) & (width > 0), F.lit(False)
    )
    zero, one = F.lit(0.0), F.lit(1.0)
    named = (F.col(suffix) == ".wav").cast("double")
    facts = F.when(
        good,
        F.array(
            one, one, channels, rate, width * 8, rate * channels * width,
            F.log1p(F.col(size) / seconds),
        ),
    ).otherwise(F.array(named, zero, zero, zero, zero, zero, F.log1p(F.col(size).cast("double"))))
    return rows.withColumn(name, facts).drop("_riff", "_wav")
