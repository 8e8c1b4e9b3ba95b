"""The registered queries: each applies operators to whole driver tables and names its columns as its SQL does."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from byteloom.functions import bytes as B
from byteloom.functions import patterns as P
from byteloom.functions import stages as S
from byteloom.operators import names, scoring, transcode
from byteloom.operators.detect import above_threshold, column, detect, detect_all, detect_native
from byteloom.operators.options import DetectOptions
from byteloom.sources.files import spread_small
from byteloom.streaming.chunks import assembled, detect_chunks, progress, split
from byteloom.tables import codepages, registry
from byteloom.tables import names as name_tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, content): the texts as UTF-8 bytes."""
    return spread_small(read(spark, sf_dir, "documents")).select("doc_id", "lang", "source", B.utf8(F.col("text")).alias("content"))


def latin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, content): the texts that Latin-1 can hold, as Latin-1 bytes."""
    docs = spread_small(read(spark, sf_dir, "documents")).where(F.col("text").rlike(r"\A[\x00-\xFF]*\z"))
    return docs.select("doc_id", "lang", F.encode("text", "ISO-8859-1").alias("content"))


def choose(values: list, by: Column) -> Column:
    """The value at ``by`` modulo their number."""
    out = F.lit(values[-1])
    for k, v in enumerate(values[:-1]):
        out = F.when(by % len(values) == k, F.lit(v)).otherwise(out)
    return out


def data() -> Column:
    """The bytes. A function, as columns can only be made once there is a session."""
    return F.col("content")


@query
def q_byte_stats(spark, sf_dir):
    """Sizes and byte classes."""
    return documents(spark, sf_dir).select("doc_id", F.octet_length(data()).alias("n_bytes"), B.non_ascii(data()).alias("n_high"), B.count(data(), P.CONTROL).alias("n_control"), B.count(B.head(data(), 1000), r"[\x20]").alias("n_spaces"))


@query
def q_find_bytes(spark, sf_dir):
    """Subsequences and prefixes."""
    return documents(spark, sf_dir).select("doc_id", B.position(data(), "the").alias("first_the"), B.starts(data(), b"Th").alias("starts_th"), B.holds(data(), b"\xc3\xa9").alias("holds_e_acute"))


@query
def q_read_numbers(spark, sf_dir):
    """P5: whole numbers at offsets."""
    docs = documents(spark, sf_dir).where(F.octet_length(data()) >= 8)
    return docs.select("doc_id", B.number(data(), 0, 4).alias("u32_be"), B.number(data(), 0, 4, little=True).alias("u32_le"), B.number(data(), 4, 2).alias("u16_be"), B.number(data(), 4, 2, little=True).alias("u16_le"))


@query
def q_byte_sets(spark, sf_dir):
    """Whether a byte of a set occurs."""
    return latin(spark, sf_dir).select("doc_id", *[B.any_of(data(), codepages.distinguishing()[e]).alias(f"has_{e.replace('-', '_')}") for e in ("cp1254", "iso8859-14")])


@query
def q_low_bytes(spark, sf_dir):
    """Strings as the low bytes of their UTF-16 units."""
    docs = spread_small(read(spark, sf_dir, "documents"))
    return docs.select("doc_id", F.hex(B.low_bytes(F.col("text"))).alias("low_hex"))


@query
def q_ascii(spark, sf_dir):
    """G11."""
    docs = documents(spark, sf_dir).select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), "content")
    items = read(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("origin"), F.col("item_id").alias("id"), B.utf8(F.col("text")).alias("content"))
    return docs.unionByName(items).select("origin", "id", B.ascii_confidence(data()).alias("confidence"))


@query
def q_ascii_nulls(spark, sf_dir):
    """Text with NULs between its words, up to 5 % of which pass."""
    docs = documents(spark, sf_dir).select("doc_id", F.concat(data(), F.expr("unhex(repeat('00', cast(doc_id % 40 as int)))")).alias("content"))
    return docs.select("doc_id", B.ascii_confidence(data()).alias("confidence"))


@query
def q_utf8_confidence(spark, sf_dir):
    """G12."""
    docs = documents(spark, sf_dir).select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("sub"), "content")
    turns = read(spark, sf_dir, "conversations").select(F.lit("conversations").alias("origin"), F.col("conv_id").alias("id"), F.col("turn").cast("long").alias("sub"), B.utf8(F.col("text")).alias("content"))
    return docs.unionByName(turns).select("origin", "id", "sub", F.coalesce(B.utf8_bytes(data()), F.lit(0)).cast("long").alias("mb_bytes"), F.round(B.utf8_confidence(data()), 6).alias("confidence"))


@query
def q_binary_ratio(spark, sf_dir):
    """Texts behind a varying number of control bytes."""
    docs = documents(spark, sf_dir).select("doc_id", F.concat(F.expr("unhex(repeat('01', cast(doc_id % 30 as int)))"), data()).alias("content"))
    return docs.select("doc_id", B.count(data(), P.CONTROL).alias("n_control"), F.coalesce(B.is_binary(data()), F.lit(False)).alias("is_binary"))


@query
def q_bom(spark, sf_dir):
    """Each kind of mark before the texts; UTF-32 marks need whole characters behind them."""
    docs = documents(spark, sf_dir).withColumn("content", F.concat(choose([m for m, _ in S.MARKS] + [b""], F.col("doc_id")), data()))
    return docs.select("doc_id", S.mark(data()).alias("encoding"))


def _lane(data: Column, width: int, lane: int) -> Column:
    """NULs in one lane of units of ``width`` bytes."""
    return F.size(F.filter(F.regexp_extract_all(F.hex(data), F.lit(f"[0-9A-F]{{{2 * width}}}"), F.lit(0)), lambda u: F.substring(u, 2 * lane + 1, 2) == "00"))


@query
def q_utf16_lanes(spark, sf_dir):
    """NULs in each lane of UTF-16."""
    docs = spread_small(read(spark, sf_dir, "documents")).select("doc_id", F.encode("text", "UTF-16BE").alias("content"))
    return docs.select("doc_id", F.floor(F.octet_length(data()) / 2).alias("n_units"), _lane(data(), 2, 0).alias("high_nulls"), _lane(data(), 2, 1).alias("low_nulls"))


@query
def q_utf32_lanes(spark, sf_dir):
    """NULs in each lane of UTF-32."""
    docs = spread_small(read(spark, sf_dir, "documents")).select("doc_id", B.utf32(F.col("text")).alias("content"))
    return docs.select("doc_id", *[_lane(data(), 4, k).alias(f"lane{k}_nulls") for k in range(4)])


@query
def q_wide_detect(spark, sf_dir):
    """G3, G4 and their text tests: documents in UTF-16 and UTF-32 without marks, as detected."""
    texts = F.col("text")
    kinds = [F.encode(texts, "UTF-16LE"), F.encode(texts, "UTF-16BE"), B.utf32(texts, little=True), B.utf32(texts)]
    content = kinds[-1]
    for k, kind in enumerate(kinds[:-1]):
        content = F.when(F.col("doc_id") % 4 == k, kind).otherwise(content)
    docs = spread_small(read(spark, sf_dir, "documents")).where(F.length("text") >= 8).select("doc_id", content.alias("content"))
    return detect(docs, options=DetectOptions(language=False)).select("doc_id", F.col("detected.encoding").alias("encoding"))


@query
def q_escape_iso2022(spark, sf_dir):
    """An escape sequence of each kind after the texts."""
    marks = [*S.ESCAPES_2004, S.ESCAPE_EXT, *S.ESCAPES_JP, S.ESCAPES_JP[0] + b"\x0e\x0f", S.ESCAPE_KR, b"\x1b[0m"]
    return documents(spark, sf_dir).select("doc_id", S.iso2022(F.concat(data(), choose(marks, F.col("doc_id")))).alias("encoding"))


@query
def q_hz(spark, sf_dir):
    """Shifted regions, good and bad, after the texts."""
    return documents(spark, sf_dir).select("doc_id", S.is_hz(F.concat(data(), choose([b"~{VPND~}", b"~{VPN~}", b"~{V D ~}~{!!~}", b"~{", b"~{~}"], F.col("doc_id")))).alias("is_hz"))


@query
def q_utf7(spark, sf_dir):
    """Texts in UTF-7 as detected."""
    pieces = choose(["+AOk-t+AOk-", "1 + 1 = 2", "+-", "+abc-", "a+ZeVnLIqe-b"], F.col("doc_id"))
    docs = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"))
    docs = docs.select("doc_id", B.utf8(F.concat(F.lit("some words "), pieces, F.lit(" and more"))).alias("content"))
    return detect(docs, options=DetectOptions(language=False)).select("doc_id", F.col("detected.encoding").alias("encoding"))


_SIGNATURES = [*(p for p, _ in S.MAGIC), b"\x00\x00\x00\x10ftypavif", b"\x00\x00\x00\x10ftypqt  ", b"\x00\x00\x00\x10ftypisom", b"\xff\xff\xff\x10ftypisom", b"RIFF0000WEBP", b"RIFF0000XXXX", b"FORM0000AIFF", b"PK\x03\x04", b"\xca\xfe\xba\xbe\x00\x00\x00\x02", b"\xca\xfe\xba\xbe\x00\x00\x00\x34"]


@query
def q_magic(spark, sf_dir):
    """File signatures before the texts."""
    return documents(spark, sf_dir).select("doc_id", S.magic(F.concat(choose(_SIGNATURES, F.col("doc_id")), data())).alias("mime_type"))


def _member(name: bytes, content: bytes = b"") -> bytes:
    return b"PK\x03\x04" + b"\x14\x00\x00\x00\x00\x00" + b"\x00" * 8 + len(content).to_bytes(4, "little") * 2 + len(name).to_bytes(2, "little") + b"\x00\x00" + name + content


_ARCHIVES = [_member(b"readme.txt", b"hi") + _member(b"xl/workbook.xml"), _member(b"word/document.xml"), _member(b"META-INF/MANIFEST.MF"), _member(b"a-1.dist-info/WHEEL"), _member(b"mimetype", b"application/vnd.oasis.opendocument.text"), _member(b"other")]


@query
def q_zip_subtype(spark, sf_dir):
    """G8z: archives told by their members."""
    docs = read(spark, sf_dir, "documents").select("doc_id", choose(_ARCHIVES, F.col("doc_id")).alias("content"))
    return detect(docs).select("doc_id", F.col("detected.mime_type").alias("mime_type"))


def _declarations(df: DataFrame) -> DataFrame:
    """Adds the names declared (name0 to name3) and what the markup stage makes of them."""
    names_ = [f"name{k}" for k in range(len(P.DECLARATIONS) + 1)]
    df = df.select("*", *[c.alias(n) for n, (c, _) in zip(names_, S.declared_names(data()))])
    return df.withColumn("found", S.markup(B.head(data(), S.MARKUP_SCAN), [F.col(n) for n in names_]))


@query
def q_markup_html(spark, sf_dir):
    """What pages declare."""
    pages = spread_small(read(spark, sf_dir, "pages")).select("page_id", B.utf8(F.col("html")).alias("content"))
    return _declarations(pages).select("page_id", F.col("name1").alias("declared"), "found.encoding", "found.mime_type")


@query
def q_markup_declared(spark, sf_dir):
    """XML and coding declarations before the texts."""
    heads = ['<?xml version="1.0" encoding="ISO-8859-2"?>', "#!/usr/bin/python\n# -*- coding: latin-1 -*-\n", '<meta http-equiv="Content-Type" content="text/html; charset=windows-1251">', '<?xml encoding="nothing"?>', "# coding: utf-8\n"]
    docs = read(spark, sf_dir, "documents").select("doc_id", B.utf8(F.concat(choose(heads, F.col("doc_id")), F.col("text"))).alias("content"))
    return _declarations(docs).select("doc_id", "found.encoding", "found.mime_type")


def _structure_query(encoding: str) -> Query:
    def run(spark, sf_dir):
        s = F.col("s")
        rows = documents(spark, sf_dir).select("doc_id", B.condensed(data()).alias("t")).select("doc_id", B.structure(F.col("t"), encoding).alias("s"))
        return rows.select("doc_id", s["leads"].alias("leads"), s["valid"].alias("valid"), s["mb_bytes"].alias("mb_bytes"), s["lead_diversity"].alias("lead_diversity"), F.round(B.pair_ratio(s), 6).alias("ratio"))

    run.__name__ = f"q_struct_{encoding}"
    return query(run)


for _e in P.SEQUENCES:
    _structure_query(_e)


@query
def q_cjk_gate(spark, sf_dir):
    """which multi-byte candidates stay."""
    gates = scoring.gated(documents(spark, sf_dir))
    return gates.select("doc_id", *[F.col(e)["kept"].alias(e) for e in P.SEQUENCES if e != "big5"])


@query
def q_sbcs_validity(spark, sf_dir):
    """how many single-byte candidates stay."""
    found = scoring.valid_candidates(documents(spark, sf_dir))
    return found.select("doc_id", F.size("valid_candidates").alias("n_valid"), F.array_contains("valid_candidates", "cp1252").alias("cp1252"), F.array_contains("valid_candidates", "iso8859-6").alias("iso8859_6"))


@query
def q_candidates_by_era(spark, sf_dir):
    """candidates of each era."""
    eras = F.array(*[F.struct(F.lit(e.name).alias("era_name"), F.lit(int(e)).alias("mask")) for e in (*registry.Era, registry.Era.ALL)])
    picked = registry.dimension(spark).select("*", F.inline(eras)).where(F.col("era").bitwiseAND(F.col("mask")) != 0)
    return picked.groupBy("era_name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_multibyte").cast("long")).alias("n_multibyte"), F.min("ordinal").alias("first_ordinal"))


_ASKED = ["UTF8", "latin-1", "Windows-1252", "gbk", "shift_jis", "sjis", "macintosh", "koi8", "TIS620", "nonsense", "big5", "euc-jp", "ISO_8859-1:1987", "windows 1252", "ISO 8859 15"]


@query
def q_alias_lookup(spark, sf_dir):
    """names as they are spelt, resolved for each row."""
    docs = read(spark, sf_dir, "documents").select("doc_id", choose(_ASKED, F.col("doc_id")).alias("asked"))
    return docs.select("doc_id", "asked", names.lookup(F.col("asked")).alias("encoding"))


@query
def q_threshold_filter(spark, sf_dir):
    """lists of candidates cut at a threshold, whole if none reaches it."""
    conf = lambda k: F.struct(((F.col("doc_id") * 7 + k * 13 + F.length("text")) % 50 / 100.0).alias("confidence"))
    docs = read(spark, sf_dir, "documents").select("doc_id", F.array(*[conf(k) for k in range(4)]).alias("all"))
    sizes = {"n_default": above_threshold(F.col("all")), "n_custom": above_threshold(F.col("all"), 0.4), "n_ignored": above_threshold(F.col("all"), ignore=True)}
    return docs.select("doc_id", *[F.size(kept).alias(n) for n, kept in sizes.items()])


@query
def q_bigram_profile(spark, sf_dir):
    """B1: the most frequent bigrams of each language."""
    counts = scoring.bigram_counts(documents(spark, sf_dir).where("lang is not null"), keys=["lang"])
    top = counts.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "bigram"))).where("rank <= 20")
    return top.select("lang", "rank", "bigram", "n")


@query
def q_bigram_norm(spark, sf_dir):
    """B1: profiles' lengths."""
    counts = scoring.bigram_counts(documents(spark, sf_dir), keys=["doc_id"])
    return scoring.norms(counts, ["doc_id"], "n").select("doc_id", F.round("norm", 6).alias("norm"))


def _language_scores(spark, sf_dir) -> DataFrame:
    """(doc_id, lang, score): all labelled documents, whole, against models of all of them."""
    docs = documents(spark, sf_dir).where("lang is not null")
    models, idf = scoring.trained(docs, "content", "lang")
    asked = scoring.bigram_counts(docs, keys=["doc_id"], unique=True)
    return scoring.cosines(scoring.profiles(asked, idf, ["doc_id"]), models, ["doc_id"], ["lang"])


@query
def q_cosine_lang(spark, sf_dir):
    """Similarities to each language's model."""
    return _language_scores(spark, sf_dir).select("doc_id", "lang", F.round("score", 6).alias("score"))


@query
def q_best_lang(spark, sf_dir):
    """The likeliest language."""
    best = scoring.ranked(_language_scores(spark, sf_dir), ["doc_id"], ["lang"]).where("rank = 1")
    return best.select("doc_id", "lang", F.round("score", 6).alias("score"))


@query
def q_rank_topk(spark, sf_dir):
    """The three likeliest."""
    top = scoring.ranked(_language_scores(spark, sf_dir), ["doc_id"], ["lang"]).where("rank <= 3")
    return top.select("doc_id", "rank", "lang")


@query
def q_confusion_band(spark, sf_dir):
    """Candidates close enough to the first to be confused with it."""
    near = scoring.within_band(_language_scores(spark, sf_dir), ["doc_id"], ["lang"], 0.05)
    return near.select("doc_id", "rank", "lang")


@query
def q_confusion_votes(spark, sf_dir):
    """Latin-1 against Latin-9 and Mac Roman, by the bytes at which they differ."""
    found = scoring.category_votes(latin(spark, sf_dir), "iso8859-1", "iso8859-15")
    other = scoring.category_votes(latin(spark, sf_dir), "iso8859-1", "mac-roman")
    cols = lambda d, pair: d.select("doc_id", F.lit(pair).alias("pair"), "votes_a", "votes_b", "winner")
    return cols(found, "latin9").unionByName(cols(other, "mac"))


@query
def q_demote(spark, sf_dir):
    """Which niche encodings would give way for lack of a byte of their own."""
    own = codepages.distinguishing()
    return latin(spark, sf_dir).select("doc_id", *[(~B.any_of(data(), own[e])).alias(f"demote_{e.replace('-', '_')}") for e in own], B.any_of(data(), codepages.tajik()).alias("promote_koi8_t"))


@query
def q_prefer_superset(spark, sf_dir):
    """Reported names of all encodings."""
    dim = registry.dimension(spark)
    return dim.select("name", names.prefer_superset(F.col("name")).alias("preferred"), names.compat_name(F.col("name")).alias("compat"), names.compat_name(names.prefer_superset(F.col("name"))).alias("both"))


@query
def q_language_names(spark, sf_dir):
    """Languages of encodings and their names."""
    dim = registry.dimension(spark)
    own = names.single_language(F.col("name"))
    return dim.select("name", own.alias("language"), names.language_name(own).alias("language_name"), names.language_code(names.language_name(own)).alias("code"))


@query
def q_is_correct(spark, sf_dir):
    """Which detections are right for which truths, over all pairs of encodings."""
    every = F.array(*map(F.lit, registry.REGISTRY))
    pairs = registry.dimension(spark).select(F.col("name").alias("expected"), F.explode(every).alias("detected"))
    return pairs.groupBy("expected").agg(F.sum(names.is_correct(F.col("expected"), F.col("detected")).cast("long")).alias("n_accepted"))


@query
def q_lang_equiv(spark, sf_dir):
    """Which languages count for each other."""
    langs = spark.createDataFrame([(x,) for x in name_tables.LANGUAGES], "a string")
    pairs = langs.select("a", F.explode(F.array(*map(F.lit, name_tables.LANGUAGES))).alias("b"))
    return pairs.where(names.is_language_equivalent(F.col("a"), F.col("b"))).select("a", "b")


@query
def q_reads_alike(spark, sf_dir):
    """E5: whether two code pages read a document alike but for marks."""
    docs = latin(spark, sf_dir)
    return docs.select("doc_id", transcode.reads_alike(data(), F.lit("latin-1"), F.lit("cp1252")).alias("cp1252"), transcode.reads_alike(data(), F.lit("latin-1"), F.lit("iso8859-15")).alias("latin9"))


@query
def q_transcode(spark, sf_dir):
    """Latin-1 bytes back to UTF-8."""
    docs = latin(spark, sf_dir)
    return docs.select("doc_id", F.md5(transcode.transcode(data(), F.lit("iso8859-1"))).alias("text_md5"))


@query
def q_accuracy_by_lang(spark, sf_dir):
    """E4 and the accuracy roll-up: likeliest language against the label."""
    best = scoring.ranked(_language_scores(spark, sf_dir), ["doc_id"], ["lang"]).where("rank = 1").select("doc_id", F.col("lang").alias("found"))
    judged = read(spark, sf_dir, "documents").select("doc_id", "lang").join(best, "doc_id")
    ok = names.is_language_equivalent(F.col("lang"), F.col("found")).cast("long")
    rolled = judged.rollup("lang").agg(F.grouping("lang").cast("int").alias("is_total"), F.count(F.lit(1)).alias("n"), F.sum(ok).alias("n_correct"))
    return rolled.select("lang", "is_total", "n", "n_correct")


def _everything(spark, sf_dir) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.lit("documents").alias("origin"), "content")
    pages = spread_small(read(spark, sf_dir, "pages")).select(F.lit("pages").alias("origin"), B.utf8(F.col("html")).alias("content"))
    turns = read(spark, sf_dir, "conversations").select(F.lit("conversations").alias("origin"), B.utf8(F.col("text")).alias("content"))
    return docs.unionByName(pages).unionByName(turns)


@query
def q_detect_mix(spark, sf_dir):
    """The deterministic stages over three tables, by what they find. Rows that native stages can't decide go through Arrow."""
    found = detect(_everything(spark, sf_dir), options=DetectOptions(language=False, compat_names=False))
    counts = found.groupBy("origin", F.col("detected.encoding").alias("encoding"), F.col("detected.mime_type").alias("mime_type"))
    return counts.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("detected.confidence"), 6).alias("mean_confidence"))


@query
def q_detect_join_labels(spark, sf_dir):
    """Detection joined to labels."""
    labels = read(spark, sf_dir, "labels")
    docs = documents(spark, sf_dir).join(labels.select("doc_id"), "doc_id", "left_semi")
    found = detect(docs, options=DetectOptions(language=False)).select("doc_id", F.col("detected.encoding").alias("encoding"))
    joined = found.join(labels, "doc_id")
    return joined.groupBy("encoding", "quality").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("toxic").cast("long")).alias("n_toxic"))


@query
def q_stream_chunks(spark, sf_dir):
    """Content cut into 64-byte chunks, put together again up to a limit."""
    chunks = split(documents(spark, sf_dir), 64, "doc_id")
    whole = assembled(chunks, "doc_id")
    return whole.select("doc_id", F.octet_length(data()).alias("n_bytes"), F.md5(data()).alias("content_md5"))


@query
def q_stream_detect(spark, sf_dir):
    """Detection of streams put together from 64-byte chunks."""
    chunks = split(documents(spark, sf_dir), 64, "doc_id")
    found = detect_chunks(chunks, "doc_id", options=DetectOptions(language=False))
    return found.select("doc_id", F.col("detected.encoding").alias("encoding"), F.round("detected.confidence", 6).alias("confidence"))


@query
def q_running_bytes(spark, sf_dir):
    """Bytes before each turn of a conversation, and whether a limit is reached with it."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", B.utf8(F.col("text")).alias("content"))
    return progress(turns, "conv_id", "turn", "content", 500).select("conv_id", "turn", "before", "done")


@query
def q_encoding_scores(spark, sf_dir):
    """How well each encoding fits, with its likeliest language, for Latin-1 bytes."""
    found = scoring.encoding_scores(latin(spark, sf_dir), id_col="doc_id")
    return found.select("doc_id", "encoding", F.round("score", 6).alias("score"), "language")


@query
def q_detect_all_long(spark, sf_dir):
    """All candidates of Latin-1 documents."""
    return detect_all(latin(spark, sf_dir).select("doc_id", "content"), id_cols=["doc_id"]).select("doc_id", "rank", "encoding", F.round("confidence", 6).alias("confidence"), "language", "mime_type")


@query
def q_detect_full(spark, sf_dir):
    """Everything, languages included, with display names."""
    found = detect(documents(spark, sf_dir))
    return found.select("doc_id", "detected.*").withColumn("confidence", F.round("confidence", 6))


@query
def q_detect_column(spark, sf_dir):
    """Detection as one column expression."""
    pages = spread_small(read(spark, sf_dir, "pages")).select("page_id", column(B.utf8(F.col("html"))).alias("r"))
    return pages.select("page_id", "r.encoding", "r.mime_type")


@query
def q_detect_native(spark, sf_dir):
    """The native stages alone; rows that need more have no result."""
    found = detect_native(documents(spark, sf_dir), options=DetectOptions(language=False))
    return found.select("doc_id", F.col("detected").isNotNull().alias("decided"), F.col("detected.encoding").alias("encoding"))


@query
def q_era_filter(spark, sf_dir):
    """Detection with UTF-8 alone, where plain ASCII is left to statistics."""
    options = DetectOptions(include_encodings=("utf-8",), no_match_encoding="utf-8", language=False)
    found = detect(documents(spark, sf_dir), options=options)
    return found.select("doc_id", F.col("detected.encoding").alias("encoding"), (F.col("detected.confidence") >= 0.8).alias("is_structural"))
