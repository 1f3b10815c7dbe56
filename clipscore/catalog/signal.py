"""Container, waveform, spectrum and clip-feature queries (C, A16-A17, D, E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from clipscore import views
from clipscore.catalog.common import Catalog, r6, s6, with_
from clipscore.functions import containers as C
from clipscore.functions import spectral as Sp
from clipscore.functions import vectors as V
from clipscore.operators import clip_features as CF
from clipscore.operators import frames as Fr
from clipscore.sources import listing as L

catalog = Catalog()

BINS, STEP = 64, 8000.0 / 63


def elements(df, column, *keys):
    """One row per vector element, rounded."""
    return df.select(*keys, F.posexplode(column).alias("pos", "value")).withColumn(
        "value", r6(F.col("value").cast("double"))
    )


# -- C: container checks over the bytes rendered from the documents -------------------------------

FAULTS = {
    0: ("none", "consistent"), 1: ("size", "inconsistent"), 2: ("magic", "inconsistent"),
    3: ("variant", "unknown"), 4: ("align", "inconsistent"), 5: ("trailing", "consistent"),
    6: ("channels", "inconsistent"), 7: ("extra", "consistent"),
}


def faulty_wavs(spark, sf):
    """WAV bytes with one fault per document, by id: oversized RIFF size, wrong magic, RF64, wrong
    alignment, bytes after the end, zero channels, an extra odd chunk before the data."""
    rows = views.clips(spark, sf)
    c, k = F.col("content"), F.col("clip_id") % 8

    def put(offset: int, data: str):
        """Overwrite bytes at a fixed offset."""
        width = len(data) // 2
        head = F.substring(c, F.lit(1), F.lit(offset)) if offset else F.unhex(F.lit(""))
        return F.concat(head, F.unhex(F.lit(data)), F.substring(c, F.lit(offset + width + 1), F.length(c)))

    grown = F.concat(
        F.lit("52494646"), views._le(F.col("length") - 8 + 12, 4), F.hex(F.substring(c, F.lit(9), F.lit(28))),
        F.lit("4C495354" + "03000000" + "61626300"),
    )
    extra = F.concat(F.unhex(grown), F.substring(c, F.lit(37), F.length(c)))
    content = (
        F.when(k == 1, put(4, "FFFFFF7F"))
        .when(k == 2, put(0, "49443304"))
        .when(k == 3, put(0, "52463634"))
        .when(k == 4, put(32, "0200"))
        .when(k == 5, F.concat(c, F.unhex(F.lit("AABBCC"))))
        .when(k == 6, put(22, "0000"))
        .when(k == 7, extra)
        .otherwise(c)
    )
    return rows.select("clip_id", "n_bytes", content.alias("content")).select(
        "*", F.octet_length("content").cast("long").alias("length"), F.lit(".wav").alias("suffix")
    )


FAULT_SQL = "CASE doc_id % 8 " + " ".join(f"WHEN {k} THEN '{s}'" for k, (_, s) in FAULTS.items()) + " END"


@catalog.add("c1_wav_walk", f"SELECT doc_id AS clip_id, {FAULT_SQL} AS status FROM documents")
def c1_wav_walk(spark, sf):
    out = C.with_verdict(faulty_wavs(spark, sf))
    return out.select("clip_id", F.col("container.status").alias("status"))


REASONS = {
    0: "RIFF/WAVE chunks and PCM alignment", 1: "RIFF size is larger than the file",
    2: "not a RIFF/WAVE header", 3: "WAVE variant is not checked",
    4: "sample width and alignment disagree", 5: "RIFF/WAVE chunks and PCM alignment",
    6: "channels, rate or alignment out of range", 7: "RIFF/WAVE chunks and PCM alignment",
}
REASON_SQL = "CASE doc_id % 8 " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in REASONS.items()) + " END"


@catalog.add(
    "c1_wav_reasons",
    f"SELECT {FAULT_SQL} AS status, {REASON_SQL} AS reason, count(*) AS n FROM documents GROUP BY 1, 2",
)
def c1_wav_reasons(spark, sf):
    out = C.with_verdict(faulty_wavs(spark, sf))
    reason = F.coalesce(F.get("container.inconsistencies", 0), F.get("container.checks", 0))
    status = F.col("container.status").alias("status")
    return out.groupBy(status, reason.alias("reason")).agg(F.count("*").alias("n"))


STUBS = (
    # suffix, bytes before the document text, expected status (the text itself is the audio body)
    (".flac", "664C614300000022100010000000000000000AC442F000000000000000000000000000000000000000000000", "consistent"),
    (".flac", "664C614380000021", "inconsistent"),
    (".mp3", "4944330400000000000A", "mp3"),
    (".mp3", "FFFB9000", "consistent"),
    (".mp3", "4944330900000000000A", "inconsistent"),
    (".m4a", "0000000866747970", "consistent"),
    (".mp4", "0000000866747971", "inconsistent"),
    (".ogg", "4F67675300", "consistent"),
    (".opus", "4F67675301", "inconsistent"),
    (".aiff", "464F524D0000000041494643", "consistent"),
    (".aif", "464F524D0000000041494647", "inconsistent"),
    (".webm", "1A45DFA3", "consistent"),
    (".wma", C.ASF, "consistent"),
    (".aac", "FFF1", "consistent"),
    (".aac", "FEF1", "inconsistent"),
    (".xyz", "00", "unknown"),
)


def stub_rows(spark, sf, suffixes):
    """Documents behind a header stub of one of the given suffixes, chosen by id."""
    stubs = [s for s in STUBS if s[0] in suffixes]
    pick = F.col("doc_id") % len(stubs)

    def choose(i: int):
        out = F.lit(stubs[0][i])
        for k, stub in enumerate(stubs):
            out = F.when(pick == k, stub[i]).otherwise(out)
        return out

    docs = views.table(spark, sf, "documents").select("doc_id", "text")
    content = F.concat(F.unhex(choose(1)), F.encode("text", "UTF-8"))
    return docs.select(
        F.col("doc_id").alias("clip_id"), choose(0).alias("suffix"), content.alias("content")
    ).withColumn("length", F.octet_length("content").cast("long"))


def stub_sql(suffixes):
    stubs = [s for s in STUBS if s[0] in suffixes]
    n = len(stubs)
    status = " ".join(
        f"WHEN {k} THEN "
        + ("CASE WHEN strlen(text) + 10 > 20 THEN 'consistent' ELSE 'inconsistent' END" if st == "mp3" else f"'{st}'")
        for k, (_, _, st) in enumerate(stubs)
    )
    suffix = " ".join(f"WHEN {k} THEN '{s[0]}'" for k, s in enumerate(stubs))
    return f"SELECT doc_id AS clip_id, CASE doc_id % {n} {suffix} END AS suffix, CASE doc_id % {n} {status} END AS status FROM documents"


def stub_query(key, suffixes):
    @catalog.add(key, stub_sql(suffixes))
    def query(spark, sf):
        out = C.with_verdict(stub_rows(spark, sf, suffixes))
        return out.select("clip_id", "suffix", F.col("container.status").alias("status"))

    return query


c2_flac = stub_query("c2_flac_header", (".flac",))
c3_mp3 = stub_query("c3_mp3_header", (".mp3",))
c4_mp4 = stub_query("c4_mp4_box", (".m4a", ".mp4"))
c5_prefix = stub_query("c5_prefix_rules", (".ogg", ".opus", ".aiff", ".aif", ".webm", ".wma", ".aac"))
c6_stubs = stub_query("c6_dispatch", tuple(dict.fromkeys(s[0] for s in STUBS)))


@catalog.add(
    "c5_page_prefixes",
    with_(views.CONTAINERS)
    + " SELECT suffix, upper(hex(head)) = upper(hex('<!DOCTYPE html>')) AS matches, count(*) AS n FROM containers GROUP BY 1, 2",
)
def c5_page_prefixes(spark, sf):
    """The prefix rule applied to page text instead of audio bytes."""
    magic = "<!DOCTYPE html>".encode().hex().upper()
    rows = views.table(spark, sf, "pages").join(
        views.containers(spark, sf).select(F.col("clip_id").alias("page_id"), "suffix"), "page_id"
    )
    hit = C.hex_at(F.encode("html", "UTF-8"), 0, len(magic) // 2) == magic
    return rows.groupBy("suffix", hit.alias("matches")).agg(F.count("*").alias("n"))


TERMS = ", ".join(f"'{t}'" for t in L.ENCODER_TERMS)


@catalog.add(
    "c7_tag_flags",
    f"""WITH tags AS (SELECT page_id AS clip_id, lower(concat('Host ', url)) AS kv FROM pages WHERE page_id % 3 <> 0
 UNION ALL SELECT page_id, lower(concat('Body ', html)) FROM pages WHERE page_id % 3 = 1)
 SELECT p.page_id AS clip_id, CASE WHEN count(kv) > 0 THEN 1e0 ELSE 0e0 END AS has_metadata,
 CASE WHEN coalesce(bool_or(len(list_filter([{TERMS}], lambda t: contains(kv, t))) > 0), false) THEN 1e0 ELSE 0e0 END AS has_encoder_tag
 FROM pages p LEFT JOIN tags t ON p.page_id = t.clip_id GROUP BY p.page_id""",
)
def c7_tag_flags(spark, sf):
    pages = views.table(spark, sf, "pages").withColumnRenamed("page_id", "clip_id")
    host = pages.where("clip_id % 3 <> 0").select(
        "clip_id", F.lit("Host").alias("key"), F.col("url").alias("value")
    )
    body = pages.where("clip_id % 3 = 1").select(
        "clip_id", F.lit("Body").alias("key"), F.col("html").alias("value")
    )
    return L.tag_flags(pages.select("clip_id"), host.unionByName(body))


@catalog.add(
    "c8_wav_facts",
    f"""SELECT doc_id AS clip_id, 1e0 AS is_wav, 1e0 AS pcm_format, 1e0 AS channels, 4000e0 AS source_sample_rate, 8e0 AS bits_per_sample,
 4000e0 AS source_bytes_per_second, {s6('ln(1e0 + (strlen(text) + strlen(text) % 2 + 44) / greatest(strlen(text)/4000e0, 1e-6))')} AS log_file_bytes_per_second FROM documents""",
)
def c8_wav_facts(spark, sf):
    rows = C.with_wav_facts(views.clips(spark, sf).withColumn("suffix", F.lit(".wav")))
    return rows.select(
        "clip_id", *[r6(F.get("header", i)).alias(n) for i, n in enumerate(V.ENCODING_HEADER)]
    )


# -- A16, A17: decode and admission -----------------------------------------------------------


@catalog.add(
    "a16_decode",
    f"""WITH d AS (SELECT doc_id, strlen(text) AS n FROM documents)
 SELECT doc_id AS clip_id, CASE WHEN n*4 < 8000 THEN 'under half a second of mono sound' END AS reason,
 CASE WHEN n*4 >= 8000 THEN n*4 END AS samples FROM d""",
)
def a16_decode(spark, sf):
    """8-bit PCM at 4 kHz decoded to 16 kHz: four output samples per byte of the whole clip."""
    out = CF.decoded(views.clips(spark, sf))
    n = F.when(F.col("reason").isNull(), F.size("wave").cast("long"))
    return out.select("clip_id", "reason", n.alias("samples"))


@catalog.add(
    "a17_admission",
    with_(views.FRAMES)
    + """ SELECT clip_id, CASE WHEN count(*) < 60 THEN 'too short' WHEN clip_id % 9 = 4 THEN 'silence or non-finite samples' END AS reason FROM frames GROUP BY clip_id""",
)
def a17_admission(spark, sf):
    """Planted faults: NaN or silence in some series; 60 samples stand for half a second."""
    x = F.when(F.col("clip_id") % 18 == 4, F.lit(float("nan"))).when(F.col("clip_id") % 18 == 13, 0.0)
    rows = views.frames(spark, sf).withColumn("x", x.otherwise(F.col("x")))
    return Fr.admission(rows, "x", 60)


# -- D: frame measures --------------------------------------------------------------------------


@catalog.add(
    "d1_stft_frames",
    """WITH d AS (SELECT doc_id, strlen(text)*4 AS n FROM documents)
 SELECT doc_id AS clip_id, 1 + n // 512 AS frames, 513 AS bins FROM d WHERE n >= 8000""",
)
def d1_stft_frames(spark, sf):
    """Frame and bin counts of the centred transform (values are tested against tones)."""
    out = CF.spectra(views.clips(spark, sf), 1024, 512)
    return out.groupBy("clip_id").agg(
        F.count("*").alias("frames"), F.max(F.size("mag")).alias("bins")
    )


@catalog.add(
    "d2_peak_normalized",
    with_(views.FRAMES)
    + f" SELECT clip_id, frame_idx, {s6('x / max(abs(x)) OVER (PARTITION BY clip_id)')} AS y FROM frames",
)
def d2_peak_normalized(spark, sf):
    out = Fr.peak_normalized(views.frames(spark, sf), "x", "y")
    return out.select("clip_id", "frame_idx", r6("y").alias("y"))


@catalog.add("d3_common_band")
def d3_common_band(spark, sf):
    """Share of power above 5 kHz before and after the zero-phase low-pass at 4 kHz."""

    def high(clips, cutoff, name, *keep):
        rows = CF.measure(clips, (), True, cutoff, keep).where("reason IS NULL")
        return rows.select("clip_id", *keep, CF.fact("high").alias(name))

    # The bytes ride along, so they are rendered once and nothing is joined.
    full = high(views.clips(spark, sf).select("clip_id", "content"), None, "raw_high", "content")
    joined = high(full, 4000.0, "v", "raw_high")
    return joined.agg(F.count("*").alias("clips"), F.avg("raw_high").alias("raw"), F.avg("v").alias("low"))


@catalog.add(
    "d4_zero_crossings",
    with_(views.FRAMES)
    + f""", s AS (SELECT clip_id, (x < -1e-10) <> (lag(x) OVER (PARTITION BY clip_id ORDER BY frame_idx) < -1e-10) AS c FROM frames)
 SELECT clip_id, {s6('avg(CASE WHEN c THEN 1e0 ELSE 0e0 END)')} AS zcr FROM s GROUP BY clip_id""",
)
def d4_zero_crossings(spark, sf):
    rows = Fr.with_previous(views.frames(spark, sf), "x")
    change = Fr.sign_change(F.col("x"), F.col("prev_x"))
    return rows.groupBy("clip_id").agg(r6(F.avg(change)).alias("zcr"))


EL = """el AS (SELECT clip_id, CAST(generate_subscripts(mag, 1) - 1 AS INT) AS i, unnest(mag) AS v FROM spectra),
fr AS (SELECT clip_id, i, v, (i*8000e0/63) AS f FROM el),
sm AS (SELECT clip_id, sum(v) AS s, sum(v*v) AS p, sum(f*v)/sum(v) AS c FROM fr GROUP BY clip_id)"""


@catalog.add(
    "d5_rms",
    with_(views.SPECTRA, EL)
    + f" SELECT clip_id, {s6('sqrt(2e0*sum(v*v*CASE WHEN i IN (0, 63) THEN 5e-1 ELSE 1e0 END)/(126e0*126e0))')} AS rms FROM el GROUP BY clip_id",
)
def d5_rms(spark, sf):
    return views.spectra(spark, sf).select("clip_id", r6(Sp.rms(F.col("mag"), BINS)).alias("rms"))


@catalog.add(
    "d6_centroid", with_(views.SPECTRA, EL) + f" SELECT clip_id, {s6('c')} AS centroid, {s6('c/8000e0')} AS relative FROM sm"
)
def d6_centroid(spark, sf):
    c = Sp.centroid(F.col("mag"), STEP)
    return views.spectra(spark, sf).select(
        "clip_id", r6(c).alias("centroid"), r6(c / 8000.0).alias("relative")
    )


@catalog.add(
    "d7_bandwidth",
    with_(views.SPECTRA, EL)
    + f" SELECT fr.clip_id, {s6('sqrt(sum(v/s*(f-c)*(f-c)))')} AS bandwidth FROM fr JOIN sm ON fr.clip_id = sm.clip_id GROUP BY fr.clip_id",
)
def d7_bandwidth(spark, sf):
    return views.spectra(spark, sf).select(
        "clip_id", r6(Sp.bandwidth(F.col("mag"), STEP)).alias("bandwidth")
    )


@catalog.add(
    "d8_rolloff",
    with_(views.SPECTRA, EL)
    + f""", cu AS (SELECT fr.clip_id, f, sum(v) OVER (PARTITION BY fr.clip_id ORDER BY i) AS run, s FROM fr JOIN sm ON fr.clip_id = sm.clip_id)
 SELECT clip_id, {s6('min(f)')} AS rolloff FROM cu WHERE run >= 85e-2*s GROUP BY clip_id""",
)
def d8_rolloff(spark, sf):
    return views.spectra(spark, sf).select(
        "clip_id", r6(Sp.rolloff(F.col("mag"), STEP)).alias("rolloff")
    )


@catalog.add(
    "d9_flatness",
    with_(views.SPECTRA, EL)
    + f" SELECT clip_id, {s6('exp(avg(ln(greatest(v*v, 1e-10))))/avg(greatest(v*v, 1e-10))')} AS flatness FROM el GROUP BY clip_id",
)
def d9_flatness(spark, sf):
    return views.spectra(spark, sf).select(
        "clip_id", r6(Sp.flatness(F.col("mag"), BINS)).alias("flatness")
    )


@catalog.add(
    "d10_flux",
    with_(views.SPECTRA, EL)
    + f""", sh AS (SELECT fr.clip_id, fr.clip_id // 8 AS g, i, v/greatest(s, 1e-10) AS q FROM fr JOIN sm ON fr.clip_id = sm.clip_id),
 df AS (SELECT clip_id, q - lag(q) OVER (PARTITION BY g, i ORDER BY clip_id) AS d FROM sh)
 SELECT clip_id, {s6('coalesce(sqrt(sum(d*d)), 0e0)')} AS flux FROM df GROUP BY clip_id""",
)
def d10_flux(spark, sf):
    """Rows of one group of eight stand for successive frames of a clip."""
    rows = views.spectra(spark, sf).select(
        F.col("clip_id").alias("row"),
        F.floor(F.col("clip_id") / 8).alias("clip_id"),
        (F.col("clip_id") % 8).cast("int").alias("frame_idx"),
        "mag",
    )
    out = Fr.with_previous(rows, "mag")
    return out.select(
        F.col("row").alias("clip_id"), r6(Sp.flux(F.col("mag"), F.col("prev_mag"))).alias("flux")
    )


@catalog.add(
    "d11_band_energy",
    with_(views.SPECTRA, EL)
    + f""" SELECT fr.clip_id, {s6('sum(CASE WHEN f < 500 THEN v*v ELSE 0e0 END)/greatest(max(p), 1e-10)')} AS low,
 {s6('sum(CASE WHEN f >= 500 AND f < 2000 THEN v*v ELSE 0e0 END)/greatest(max(p), 1e-10)')} AS mid,
 {s6('sum(CASE WHEN f >= 2000 THEN v*v ELSE 0e0 END)/greatest(max(p), 1e-10)')} AS high
 FROM fr JOIN sm ON fr.clip_id = sm.clip_id GROUP BY fr.clip_id""",
)
def d11_band_energy(spark, sf):
    m = F.col("mag")
    return views.spectra(spark, sf).select(
        "clip_id",
        r6(Sp.band_share(m, STEP, 0, 500)).alias("low"),
        r6(Sp.band_share(m, STEP, 500, 2000)).alias("mid"),
        r6(Sp.band_share(m, STEP, 2000, 8001)).alias("high"),
    )


def dct_sql(source: str, n: int, low: int, high: int, value: str) -> str:
    return f"""SELECT clip_id, CAST(k - {low} AS INT) AS pos,
 {s6(f"sum({value}*cos(pi()*k*(2*i+1)/(2e0*{n})))*sqrt(CASE WHEN k = 0 THEN 1e0 ELSE 2e0 END/{n}e0)")} AS value
 FROM {source}, range({low}, {high}) q(k) GROUP BY clip_id, k"""


@catalog.add(
    "d12_cepstra",
    with_(views.SPECTRA, EL, "db AS (SELECT clip_id, i, 1e1*log10(greatest(v*v, 1e-10)) AS d FROM el)")
    + " "
    + dct_sql("db", 64, 0, 20, "d"),
)
def d12_cepstra(spark, sf):
    """Decibel spectrum to 20 cepstra including the level coefficient."""
    db = F.transform("mag", lambda v: 10 * F.log10(F.greatest(v * v, F.lit(1e-10))))
    rows = views.spectra(spark, sf).select("clip_id", Sp.dct(db, BINS, 20).alias("c"))
    return elements(rows, "c", "clip_id")


@catalog.add("d12_mfcc_means")
def d12_mfcc_means(spark, sf):
    """Mel cepstra of the rendered clips: mean over frames per coefficient."""
    good, _ = CF.features(views.clips(spark, sf), ("mfcc",))
    part = V.pick_by_name(F.col("mfcc"), V.PARTS["mfcc"], lambda n: n.endswith("_mean"))
    return elements(good.select("clip_id", part.alias("v")), "v", "clip_id")


@catalog.add("d13_chroma_means")
def d13_chroma_means(spark, sf):
    good, _ = CF.features(views.clips(spark, sf), ("chroma",))
    part = V.pick_by_name(F.col("chroma"), V.PARTS["chroma"], lambda n: n.endswith("_mean"))
    return elements(good.select("clip_id", part.alias("v")), "v", "clip_id")


BANK = """tri AS (SELECT j, i, greatest(0e0, 1e0 - abs(i*9e0/63 - j)) AS w FROM range(1, 9) a(j), range(0, 64) b(i)),
bank AS (SELECT j, i, w/sum(w) OVER (PARTITION BY j) AS w FROM tri),
en AS (SELECT clip_id, CAST(j - 1 AS INT) AS i, ln(greatest(sum(w*v*v), 1e-10)) AS e FROM el JOIN bank ON el.i = bank.i GROUP BY clip_id, j)"""


@catalog.add(
    "d14_linear_filters",
    with_(views.SPECTRA, EL, BANK) + f" SELECT clip_id, i AS pos, {s6('e')} AS value FROM en",
)
def d14_linear_filters(spark, sf):
    rows = views.spectra(spark, sf).select("clip_id", Sp.bank_energy(F.col("mag"), 8, BINS).alias("e"))
    return elements(rows, "e", "clip_id")


@catalog.add(
    "d15_linear_cepstra", with_(views.SPECTRA, EL, BANK) + " " + dct_sql("en", 8, 1, 8, "e")
)
def d15_linear_cepstra(spark, sf):
    """Log filter energies to cepstra without the level coefficient."""
    e = Sp.bank_energy(F.col("mag"), 8, BINS)
    rows = views.spectra(spark, sf).select("clip_id", e.alias("e"))
    rows = rows.select("clip_id", F.slice(Sp.dct(F.col("e"), 8, 8), 2, 7).alias("c"))
    return elements(rows, "c", "clip_id")


def fit_sql(kernel: str) -> str:
    terms = "+".join(
        f"({eval(kernel, {'k': k})})*" + (f"lead(x, {k}) OVER o" if k > 0 else f"lag(x, {-k}) OVER o" if k else "x")
        for k in range(-4, 5)
    )
    return terms


DELTAS = f"""mid AS (SELECT clip_id, frame_idx, n_frames, x, ({fit_sql('k')})/60e0 AS d1, ({fit_sql('3*k*k-20')})/462e0 AS d2
 FROM frames WINDOW o AS (PARTITION BY clip_id ORDER BY frame_idx)),
deltas AS (SELECT a.clip_id, a.frame_idx, a.n_frames, a.x, b.d1 AS delta, b.d2 AS delta2 FROM mid a JOIN mid b
 ON a.clip_id = b.clip_id AND b.frame_idx = greatest(4, least(a.frame_idx, a.n_frames - 5)))"""


@catalog.add(
    "d16_first_delta",
    with_(views.FRAMES, DELTAS) + f" SELECT clip_id, frame_idx, {s6('delta')} AS delta FROM deltas",
)
def d16_first_delta(spark, sf):
    out = Fr.derivatives(views.frames(spark, sf), "x")
    return out.select("clip_id", "frame_idx", r6("delta").alias("delta"))


@catalog.add(
    "d17_second_delta",
    with_(views.FRAMES, DELTAS) + f" SELECT clip_id, frame_idx, {s6('delta2')} AS delta2 FROM deltas",
)
def d17_second_delta(spark, sf):
    out = Fr.derivatives(views.frames(spark, sf), "x")
    return out.select("clip_id", "frame_idx", r6("delta2").alias("delta2"))


# -- E: clip features -------------------------------------------------------------------------


def vector_sql(source: str, columns: list[str]) -> str:
    parts = []
    for i, c in enumerate(columns):
        parts.append(f"SELECT clip_id, {2 * i} AS pos, avg({c}) AS v FROM {source} GROUP BY clip_id")
        parts.append(f"SELECT clip_id, {2 * i + 1}, stddev_pop({c}) FROM {source} GROUP BY clip_id")
    return f"SELECT clip_id, pos, {s6('CAST(v AS FLOAT)')} AS value FROM (" + " UNION ALL ".join(parts) + ") q"


@catalog.add(
    "e1_mean_std_vector",
    with_(views.FRAMES, "s AS (SELECT clip_id, x, abs(x) AS y, x*x AS z FROM frames)")
    + " "
    + vector_sql("s", ["x", "y", "z"]),
)
def e1_mean_std_vector(spark, sf):
    x = F.col("x")
    rows = views.frames(spark, sf).select("clip_id", "x", F.abs(x).alias("y"), (x * x).alias("z"))
    return elements(Fr.mean_std_vector(rows, ["x", "y", "z"]), "vector", "clip_id")


@catalog.add(
    "e2_delta_vector", with_(views.FRAMES, DELTAS) + " " + vector_sql("deltas", ["x", "delta", "delta2"])
)
def e2_delta_vector(spark, sf):
    rows = Fr.derivatives(views.frames(spark, sf), "x")
    return elements(Fr.mean_std_vector(rows, ["x", "delta", "delta2"]), "vector", "clip_id")


WIN = """w AS (SELECT clip_id, b, x, x*x AS z FROM frames, range(0, 8) q(b)
 WHERE frame_idx >= floor(b*n_frames/8e0) AND frame_idx < floor((b+1)*n_frames/8e0)),
ws AS (SELECT clip_id, b AS win, count(*) AS frames, avg(x) AS xm, stddev_pop(x) AS xs, avg(z) AS zm, stddev_pop(z) AS zs FROM w GROUP BY clip_id, b),
tr AS (SELECT clip_id, regr_slope(xm, -1e0+2e0*win/7e0) AS tx, regr_slope(zm, -1e0+2e0*win/7e0) AS tz FROM ws GROUP BY clip_id)"""


def squared(spark, sf):
    return views.frames(spark, sf).withColumn("z", F.col("x") * F.col("x"))


@catalog.add(
    "e3_ordered_windows",
    with_(views.FRAMES, WIN)
    + f" SELECT clip_id, win, frames, {s6('xm')} AS x_mean, {s6('xs')} AS x_std FROM ws",
)
def e3_ordered_windows(spark, sf):
    out = Fr.window_stats(views.frames(spark, sf), ["x"])
    return out.select("clip_id", "win", "frames", r6("x_mean").alias("x_mean"), r6("x_std").alias("x_std"))


@catalog.add(
    "e4_window_trend",
    with_(views.FRAMES, WIN) + f" SELECT clip_id, {s6('tx')} AS trend_x, {s6('tz')} AS trend_z FROM tr",
)
def e4_window_trend(spark, sf):
    out = Fr.trends(Fr.window_stats(squared(spark, sf), ["x", "z"]), ["x", "z"])
    return out.select("clip_id", r6("trend_x").alias("trend_x"), r6("trend_z").alias("trend_z"))


@catalog.add(
    "e5_temporal_vector",
    with_(views.FRAMES, WIN)
    + f""" SELECT clip_id, pos, {s6('CAST(v AS FLOAT)')} AS value FROM (
 SELECT clip_id, CAST(4*win AS INT) AS pos, xm AS v FROM ws UNION ALL SELECT clip_id, CAST(4*win+1 AS INT), xs FROM ws
 UNION ALL SELECT clip_id, CAST(4*win+2 AS INT), zm FROM ws UNION ALL SELECT clip_id, CAST(4*win+3 AS INT), zs FROM ws
 UNION ALL SELECT clip_id, 32, tx FROM tr UNION ALL SELECT clip_id, 33, tz FROM tr) q""",
)
def e5_temporal_vector(spark, sf):
    return elements(Fr.temporal_vector(squared(spark, sf), ["x", "z"]), "vector", "clip_id")


@catalog.add(
    "e6_signal_levels",
    with_(views.FRAMES, "p AS (SELECT clip_id, max(abs(x)) AS peak FROM frames GROUP BY clip_id)")
    + f""" SELECT f.clip_id, {s6('max(peak)')} AS peak, {s6('sqrt(avg(x*x))')} AS rms, {s6('avg(CASE WHEN abs(x) >= 999e-3 THEN 1e0 ELSE 0e0 END)')} AS clipped,
 {s6('avg(CASE WHEN abs(x) > greatest(peak*15e-3, 1e-5) THEN 1e0 ELSE 0e0 END)')} AS active FROM frames f JOIN p ON f.clip_id = p.clip_id GROUP BY f.clip_id""",
)
def e6_signal_levels(spark, sf):
    out = Fr.signal_levels(views.frames(spark, sf), "x")
    return out.select("clip_id", *[r6(c).alias(c) for c in ("peak", "rms", "clipped", "active")])


@catalog.add("e6_quality_vector")
def e6_quality_vector(spark, sf):
    clips = views.clips(spark, sf).withColumn("suffix", F.lit(".wav"))
    tags = clips.where("clip_id % 2 = 0").select(
        "clip_id", F.lit("encoder").alias("key"), F.lit("Some TTS 1.0").alias("value")
    )
    good, _ = CF.features(clips, ("quality",), tags)
    return elements(good, "quality", "clip_id")


@catalog.add(
    "e7_encoding_traces",
    with_(
        views.FRAMES,
        """lv AS (SELECT clip_id, frame_idx, CAST(greatest(-32768, least(32767, round_even(x*32768, 0))) AS INT) AS l FROM frames)""",
        "rp AS (SELECT clip_id, l, l = lag(l) OVER (PARTITION BY clip_id ORDER BY frame_idx) AS same FROM lv)",
        """a AS (SELECT clip_id, coalesce(avg(CASE WHEN same IS NOT NULL THEN CASE WHEN same THEN 1e0 ELSE 0e0 END END), 0e0) AS rep,
 count(DISTINCT l)*1e0/count(*) AS uniq FROM rp GROUP BY clip_id)""",
        """b AS (SELECT clip_id, avg(CASE WHEN abs(x) >= 999e-3 THEN 1e0 ELSE 0e0 END) AS clipf, avg(CASE WHEN abs(x) < 1e-7 THEN 1e0 ELSE 0e0 END) AS zerof FROM frames GROUP BY clip_id)""",
    )
    + f""" SELECT a.clip_id, {s6('clipf')} AS clip_fraction, {s6('zerof')} AS zero_fraction, {s6('rep')} AS repeat_fraction, {s6('uniq')} AS unique_fraction FROM a JOIN b ON a.clip_id = b.clip_id""",
)
def e7_encoding_traces(spark, sf):
    """Over every sample of a series."""
    out = Fr.encoding_traces(views.frames(spark, sf), "x")
    names = ("clip_fraction", "zero_fraction", "repeat_fraction", "unique_fraction")
    return out.select("clip_id", *[r6(c).alias(c) for c in names])


@catalog.add(
    "e7_energy_cutoff",
    with_(views.SPECTRA, EL)
    + f""", cu AS (SELECT el.clip_id, i, sum(v*v) OVER (PARTITION BY el.clip_id ORDER BY i) AS run, p FROM el JOIN sm ON el.clip_id = sm.clip_id)
 SELECT clip_id, {s6('min(i)/63e0')} AS cutoff FROM cu WHERE run >= 99e-2*greatest(p, 1e-10) GROUP BY clip_id""",
)
def e7_energy_cutoff(spark, sf):
    energy = F.transform("mag", lambda v: v * v)
    rows = views.spectra(spark, sf).withColumn("p", energy)
    return rows.select("clip_id", r6(Sp.cutoff_bin(F.col("p")) / 63.0).alias("cutoff"))


@catalog.add("e8_encoding_vector")
def e8_encoding_vector(spark, sf):
    clips = views.clips(spark, sf).withColumn("suffix", F.lit(".wav"))
    good, _ = CF.features(clips, ("encoding",))
    return elements(good, "encoding", "clip_id")


@catalog.add(
    "e_clip_views",
    """WITH d AS (SELECT doc_id, strlen(text)*4 AS n FROM documents)
 SELECT doc_id AS clip_id, n AS n_samples, true AS base, true AS lfcc, true AS temporal, true AS encoding, true AS quality
 FROM d WHERE n >= 8000""",
)
def e_clip_views(spark, sf):
    """All five views of every admitted clip from one pass over the bytes."""
    clips = views.clips(spark, sf).withColumn("suffix", F.lit(".wav"))
    good, _ = CF.features(clips)
    return good.select(
        "clip_id", "n_samples", *[V.is_sound(F.col(v), len(names)).alias(v) for v, names in V.VIEWS.items()]
    )
