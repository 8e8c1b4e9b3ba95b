"""The registered queries in SQL, as DuckDB runs it on the same tables.

Bytes are the two-digit tokens of ``hex``; ``tokens`` are compared as text, which orders as the bytes do. Fixed tables
are written out from this package's own.
"""

from __future__ import annotations

from byteloom.functions import patterns as P
from byteloom.functions import stages as S
from byteloom.plans import queries as Q
from byteloom.tables import codepages, names, registry
from byteloom.tables.models import standard


def _values(rows) -> str:
    cell = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v).lower() if isinstance(v, bool) else "'" + str(v).replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)


def _choose(values: list[str], by: str) -> str:
    return f"CASE {by} % {len(values)} " + " ".join(f"WHEN {k} THEN {_values([(v,)])[1:-1]}" for k, v in enumerate(values)) + " END"


def _in(values) -> str:
    return "('" + "', '".join(f"{v:02X}" for v in sorted(values)) + "')"


#: (doc_id, lang, h, t): hex digits of the UTF-8 bytes, and the bytes as tokens.
DOCS = "d AS (SELECT doc_id, lang, hex(encode(text)) AS h, regexp_extract_all(hex(encode(text)), '..') AS t FROM documents WHERE text IS NOT NULL)"
#: The same for the Latin-1 bytes of texts that have them.
LATIN = """l AS (SELECT doc_id, lang, list_transform(regexp_extract_all(text, '(?s).'), lambda c: printf('%02X', unicode(c))) AS t
  FROM documents WHERE regexp_full_match(text, '(?s)[\\x{00}-\\x{FF}]*'))"""


def _count(condition: str, tokens: str = "t") -> str:
    return f"len(list_filter({tokens}, lambda x: {condition}))"


_CONTROL = "(x <= '08' OR (x >= '0E' AND x <= '1F'))"
_OTHER = "NOT (x IN ('09', '0A', '0D') OR (x >= '20' AND x <= '7E'))"
_ASCII = f"CASE WHEN {_count(_OTHER)} = 0 THEN 1.0::DOUBLE WHEN {_count(_OTHER)} = {_count('x = ' + chr(39) + '00' + chr(39))} AND {_count(_OTHER)} <= 0.05 * len(t) THEN 0.99::DOUBLE END"
_UTF8 = f"CASE WHEN {_count('x >= ' + chr(39) + '80' + chr(39))} > 0 THEN least(0.99, 0.80 + 0.19 * least(6.0::DOUBLE * {_count('x >= ' + chr(39) + '80' + chr(39))} / len(t), 1.0)) END"

ORACLE: dict[str, str] = {}
ORACLE["q_byte_stats"] = f"""WITH {DOCS} SELECT doc_id, len(t)::INTEGER AS n_bytes, {_count("x >= '80'")}::INTEGER AS n_high, {_count(_CONTROL)}::INTEGER AS n_control, {_count("x = '20'", "t[1:1000]")}::INTEGER AS n_spaces FROM d"""
ORACLE["q_find_bytes"] = """WITH p AS (SELECT doc_id, text, strpos(text, 'the') AS pos FROM documents WHERE text IS NOT NULL)
SELECT doc_id, (CASE WHEN pos = 0 THEN -1 ELSE octet_length(encode(substr(text, 1, pos - 1))) END)::INTEGER AS first_the, starts_with(text, 'Th') AS starts_th, contains(text, 'é') AS holds_e_acute FROM p"""
_NUM = lambda parts: "('0x' || " + " || ".join(f"t[{k + 1}]" for k in parts) + ")::BIGINT"
ORACLE["q_read_numbers"] = f"WITH {DOCS} SELECT doc_id, {_NUM([0, 1, 2, 3])} AS u32_be, {_NUM([3, 2, 1, 0])} AS u32_le, {_NUM([4, 5])} AS u16_be, {_NUM([5, 4])} AS u16_le FROM d WHERE len(t) >= 8"
ORACLE["q_byte_sets"] = f"WITH {LATIN} SELECT doc_id, " + ", ".join(f"{_count('x IN ' + _in(codepages.distinguishing()[e]))} > 0 AS has_{e.replace('-', '_')}" for e in ("cp1254", "iso8859-14")) + " FROM l"
ORACLE["q_low_bytes"] = "SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '(?s).'), lambda c: printf('%02X', unicode(c) & 255)), '') AS low_hex FROM documents"
ORACLE["q_ascii"] = f"""WITH d AS (SELECT 'documents' AS origin, doc_id AS id, regexp_extract_all(hex(encode(text)), '..') AS t FROM documents
UNION ALL SELECT 'benchmark', item_id, regexp_extract_all(hex(encode(text)), '..') FROM benchmark) SELECT origin, id, {_ASCII} AS confidence FROM d"""
ORACLE["q_ascii_nulls"] = f"WITH d AS (SELECT doc_id, regexp_extract_all(hex(encode(text)) || repeat('00', doc_id % 40), '..') AS t FROM documents) SELECT doc_id, {_ASCII} AS confidence FROM d"
ORACLE["q_utf8_confidence"] = f"""WITH d AS (SELECT 'documents' AS origin, doc_id AS id, 0::BIGINT AS sub, regexp_extract_all(hex(encode(text)), '..') AS t FROM documents
UNION ALL SELECT 'conversations', conv_id, turn, regexp_extract_all(hex(encode(text)), '..') FROM conversations)
SELECT origin, id, sub, {_count("x >= '80'")}::BIGINT AS mb_bytes, round({_UTF8}, 6) AS confidence FROM d"""
ORACLE["q_binary_ratio"] = f"WITH d AS (SELECT doc_id, regexp_extract_all(repeat('01', doc_id % 30) || hex(encode(text)), '..') AS t FROM documents) SELECT doc_id, {_count(_CONTROL)}::INTEGER AS n_control, {_count(_CONTROL)} > 0.01 * len(t) AS is_binary FROM d"
_BOM = "CASE " + " ".join(f"WHEN starts_with(h, '{m.hex().upper()}')" + (f" AND (length(h) // 2 - {len(m)}) % 4 = 0" if n == "utf-32" else "") + f" THEN '{n}'" for m, n in S.MARKS) + " END"
ORACLE["q_bom"] = f"WITH d AS (SELECT doc_id, ({_choose([m.hex().upper() for m, _ in S.MARKS] + [''], 'doc_id')}) || hex(encode(text)) AS h FROM documents) SELECT doc_id, {_BOM} AS encoding FROM d"
_CHARS = "c AS (SELECT doc_id, regexp_extract_all(text, '(?s).') AS c FROM documents)"
ORACLE["q_utf16_lanes"] = f"WITH {_CHARS} SELECT doc_id, len(c)::BIGINT AS n_units, len(list_filter(c, lambda x: unicode(x) < 256))::INTEGER AS high_nulls, len(list_filter(c, lambda x: unicode(x) % 256 = 0))::INTEGER AS low_nulls FROM c"
ORACLE["q_utf32_lanes"] = f"WITH {_CHARS} SELECT doc_id, " + ", ".join(f"len(list_filter(c, lambda x: (unicode(x) >> {24 - 8 * k}) % 256 = 0))::INTEGER AS lane{k}_nulls" for k in range(4)) + " FROM c"
ORACLE["q_wide_detect"] = "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'utf-16-le' WHEN 1 THEN 'utf-16-be' WHEN 2 THEN 'utf-32-le' ELSE 'utf-32-be' END AS encoding FROM documents WHERE length(text) >= 8"
ORACLE["q_escape_iso2022"] = "SELECT doc_id, " + _choose(["iso2022_jp_2004"] * 3 + ["iso2022_jp_ext"] + ["iso2022_jp_2"] * 4 + ["iso2022_jp_ext", "iso2022_kr", ""], "doc_id").replace("THEN ''", "THEN NULL") + " AS encoding FROM documents"
ORACLE["q_hz"] = "SELECT doc_id, doc_id % 5 IN (0, 2) AS is_hz FROM documents"
ORACLE["q_utf7"] = "SELECT item_id AS doc_id, CASE item_id % 5 WHEN 0 THEN 'utf-7' WHEN 4 THEN 'utf-7' ELSE 'ascii' END AS encoding FROM benchmark"
_MIMES = [*(m for _, m in S.MAGIC), "image/avif", "video/quicktime", "video/mp4", None, "image/webp", None, "audio/aiff", "application/zip", "application/x-mach-binary", "application/java-vm"]
ORACLE["q_magic"] = f"SELECT doc_id, m.mime AS mime_type FROM documents JOIN (VALUES {_values(enumerate(_MIMES))}) m(k, mime) ON k = doc_id % {len(_MIMES)}"
ORACLE["q_zip_subtype"] = "SELECT doc_id, " + _choose(["application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/java-archive", "application/x-wheel+zip", "application/vnd.oasis.opendocument.text", "application/zip"], "doc_id") + " AS mime_type FROM documents"
_NAMES = f"n(alias, encoding) AS (VALUES {_values(registry.names().items())})"
#: A declaration is believed only if the first 4,096 bytes decode: a character cut there speaks against it.
_CUT = "coalesce(t[4097] BETWEEN '80' AND 'BF', false)"
ORACLE["q_markup_html"] = f"""WITH {_NAMES}, p AS (SELECT page_id, regexp_extract_all(hex(encode(html)), '..') AS t, regexp_extract(html[1:4096], '(?is)<meta[^>]+charset\\s*=\\s*[''"]?\\s*([^\\s''">;]+)', 1) AS declared FROM pages)
SELECT page_id, declared, encoding, CASE WHEN encoding IS NOT NULL THEN 'text/html' END AS mime_type FROM p LEFT JOIN n ON alias = lower(declared) AND NOT {_CUT}"""
_HEADS = ['<?xml version="1.0" encoding="ISO-8859-2"?>', "#!/usr/bin/python\n# -*- coding: latin-1 -*-\n", '<meta http-equiv="Content-Type" content="text/html; charset=windows-1251">', '<?xml encoding="nothing"?>', "# coding: utf-8\n"]
#: Web decoders read any byte as Latin-1, Latin-2 or CP1251; UTF-8 has to be whole within the first 4,096 bytes.
ORACLE["q_markup_declared"] = f"""WITH d AS (SELECT doc_id, doc_id % 5 AS k, regexp_extract_all(hex(encode(({_choose(_HEADS, 'doc_id')}) || text)), '..') AS t FROM documents)
SELECT doc_id, CASE WHEN k = 0 THEN 'iso8859-2' WHEN k = 1 THEN 'iso8859-1' WHEN k = 2 THEN 'cp1251' WHEN k = 4 AND NOT {_CUT} THEN 'utf-8' END AS encoding,
       CASE WHEN k IN (0, 3) THEN 'text/xml' WHEN k = 2 THEN 'text/html' WHEN k = 1 OR NOT {_CUT} THEN 'text/x-python' END AS mime_type FROM d"""


def _hex_pattern(pattern: str) -> str:
    """A byte pattern as one over hex digits: each class becomes an alternation of digit pairs."""
    out, at = "", 0
    while at < len(pattern):
        if pattern[at] == "[":
            end = pattern.index("]", at)
            out += "(?:" + "|".join(_hex_range(*(int(x[2:], 16) for x in (part.split("-") * 2)[:2])) for part in _parts(pattern[at + 1 : end])) + ")"
            at = end + 1
        elif pattern[at] == "\\":
            out += pattern[at + 2 : at + 4]
            at += 4
        else:
            out += pattern[at]
            at += 1
    return out


def _parts(body: str) -> list[str]:
    out = []
    while body:
        size = 9 if body[4:5] == "-" else 4
        out.append(body[:size])
        body = body[size:]
    return out


def _hex_range(low: int, high: int) -> str:
    digit = lambda a, b: f"[{''.join(f'{v:X}' for v in range(a, b + 1))}]"
    rows = []
    for top in range(low >> 4, (high >> 4) + 1):
        a, b = (low & 15 if top == low >> 4 else 0), (high & 15 if top == high >> 4 else 15)
        rows.append(f"{top:X}{digit(a, b)}")
    return "|".join(rows)


def _structure(encoding: str) -> str:
    lead, sequence = P.SEQUENCES[encoding]
    seq, one = _hex_pattern(sequence), _hex_pattern(lead)
    return f"""WITH {DOCS}, k AS (
  SELECT doc_id, list_filter(regexp_extract_all(h, '{seq}|..'), lambda x: length(x) > 2) AS valid,
         len(list_filter(regexp_extract_all(h, '{seq}|..'), lambda x: length(x) > 2 OR regexp_full_match(x, '{one}'))) AS leads FROM d)
SELECT doc_id, leads::INTEGER AS leads, len(valid)::INTEGER AS valid,
       len(list_filter(regexp_extract_all(array_to_string(valid, ''), '..'), lambda x: x >= '80'))::INTEGER AS mb_bytes,
       len(list_distinct(list_transform(valid, lambda x: x[1:2])))::INTEGER AS lead_diversity,
       round(CASE WHEN leads > 0 THEN len(valid)::DOUBLE / leads ELSE 0 END, 6) AS ratio FROM k"""


for _e in P.SEQUENCES:
    ORACLE[f"q_struct_{_e}"] = _structure(_e)
_GATED = [e for e in P.SEQUENCES if e != "big5"]
ORACLE["q_cjk_gate"] = (
    f"WITH hi AS (WITH {DOCS} SELECT doc_id, {_count(chr(120) + ' >= ' + chr(39) + '80' + chr(39))} AS high FROM d), "
    + ", ".join(f"s_{e} AS ({_structure(e)})" for e in _GATED)
    + " SELECT hi.doc_id, "
    + ", ".join(f"(CASE WHEN s_{e}.leads > 0 THEN s_{e}.valid::DOUBLE / s_{e}.leads ELSE 0 END >= 0.05 AND high >= 2 AND CASE WHEN high > 0 THEN s_{e}.mb_bytes::DOUBLE / high ELSE 0 END >= 0.35 AND (high < 16 OR s_{e}.lead_diversity >= 4)) AS {e}" for e in _GATED)
    + " FROM hi "
    + " ".join(f"JOIN s_{e} USING (doc_id)" for e in _GATED)
)
_UNDEFINED = [(e, f"{v:02X}") for e in codepages.single_byte() for v in sorted(codepages.undefined(e))]
ORACLE["q_sbcs_validity"] = f"""WITH {DOCS}, u(enc, b) AS (VALUES {_values(_UNDEFINED)}),
seen AS (SELECT DISTINCT doc_id, unnest(t) AS b FROM d),
bad AS (SELECT doc_id, count(DISTINCT enc) AS n, bool_or(enc = 'cp1252') AS cp1252, bool_or(enc = 'iso8859-6') AS iso FROM seen JOIN u USING (b) GROUP BY doc_id)
SELECT d.doc_id, ({len(codepages.single_byte())} - coalesce(n, 0))::INTEGER AS n_valid, NOT coalesce(cp1252, false) AS cp1252, NOT coalesce(iso, false) AS iso8859_6 FROM d LEFT JOIN bad USING (doc_id)"""
_DIM = f"e(ordinal, name, era, mb) AS (VALUES {_values((e.ordinal, e.name, int(e.era), int(e.is_multibyte)) for e in registry.REGISTRY.values())})"
ORACLE["q_candidates_by_era"] = f"WITH {_DIM}, m(era_name, mask) AS (VALUES {_values([(x.name, int(x)) for x in (*registry.Era, registry.Era.ALL)])}) SELECT era_name, count(*) AS n, sum(mb)::BIGINT AS n_multibyte, min(ordinal)::INTEGER AS first_ordinal FROM e JOIN m ON (era & mask) <> 0 GROUP BY era_name"
#: What those names have to mean, written out.
_MEANT = ["utf-8", "iso8859-1", "cp1252", "gb18030", "shift_jis_2004", "shift_jis_2004", "mac-roman", "koi8-r", "tis-620", "", "big5hkscs", "euc_jis_2004", "iso8859-1", "cp1252", "iso8859-15"]
ORACLE["q_alias_lookup"] = f"SELECT doc_id, {_choose(Q._ASKED, 'doc_id')} AS asked, nullif({_choose(_MEANT, 'doc_id')}, '') AS encoding FROM documents"
ORACLE["q_threshold_filter"] = """WITH c AS (SELECT doc_id, list_transform([0, 1, 2, 3], lambda k: ((doc_id * 7 + k * 13 + length(text)) % 50) / 100.0) AS c FROM documents),
f AS (SELECT doc_id, len(c) AS n, len(list_filter(c, lambda x: x > 0.2)) AS a, len(list_filter(c, lambda x: x >= 0.4)) AS b FROM c)
SELECT doc_id, (CASE WHEN a = 0 THEN n ELSE a END)::INTEGER AS n_default, (CASE WHEN b = 0 THEN n ELSE b END)::INTEGER AS n_custom, n::INTEGER AS n_ignored FROM f"""
#: (doc_id, lang, bigram), one row for each pair of adjacent bytes.
PAIRS = f"{DOCS}, g AS (SELECT doc_id, lang, unnest(list_transform(range(1, len(t)), lambda k: ('0x' || t[k] || t[k + 1])::INTEGER)) AS bigram FROM d)"
ORACLE["q_bigram_profile"] = f"""WITH {PAIRS}, c AS (SELECT lang, bigram, count(*) AS n FROM g WHERE lang IS NOT NULL GROUP BY ALL),
r AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY n DESC, bigram)::INTEGER AS rank, bigram, n FROM c) SELECT * FROM r WHERE rank <= 20"""
ORACLE["q_bigram_norm"] = f"WITH {PAIRS}, c AS (SELECT doc_id, bigram, count(*) AS n FROM g GROUP BY ALL) SELECT doc_id, round(sqrt(sum(n * n)::DOUBLE), 6) AS norm FROM c GROUP BY doc_id"
#: (doc_id, lang, score) of labelled documents against models of all of them.
SCORES = """d AS (SELECT doc_id, lang, regexp_extract_all(hex(encode(text)), '..') AS t FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL),
tg AS (SELECT lang, unnest(list_transform(range(1, len(t)), lambda k: ('0x' || t[k] || t[k + 1])::INTEGER)) AS bigram FROM d),
tc AS (SELECT lang, bigram, count(*) AS n FROM tg GROUP BY ALL),
idf AS (SELECT bigram, ln(1 + (SELECT count(DISTINCT lang) FROM tc)::DOUBLE / count(*)) AS idf FROM tc GROUP BY bigram),
m AS (SELECT lang, bigram, n * idf AS w FROM tc JOIN idf USING (bigram)),
qg AS (SELECT doc_id, unnest(list_transform(range(1, len(t)), lambda k: ('0x' || t[k] || t[k + 1])::INTEGER)) AS bigram FROM d),
q AS (SELECT doc_id, bigram, n * idf AS w FROM (SELECT doc_id, bigram, count(*) AS n FROM qg GROUP BY ALL) JOIN idf USING (bigram)),
mn AS (SELECT lang, sqrt(sum(w * w)) AS norm FROM m GROUP BY lang), qn AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM q GROUP BY doc_id),
dots AS (SELECT doc_id, lang, sum(q.w * m.w) AS dot FROM q JOIN m USING (bigram) GROUP BY ALL),
scores AS (SELECT doc_id, lang, dot / (qn.norm * mn.norm) AS score FROM dots JOIN qn USING (doc_id) JOIN mn USING (lang)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang)::INTEGER AS rank, max(score) OVER (PARTITION BY doc_id) - score AS gap FROM scores)"""
ORACLE["q_cosine_lang"] = f"WITH {SCORES} SELECT doc_id, lang, round(score, 6) AS score FROM scores"
ORACLE["q_best_lang"] = f"WITH {SCORES} SELECT doc_id, lang, round(score, 6) AS score FROM ranked WHERE rank = 1"
ORACLE["q_rank_topk"] = f"WITH {SCORES} SELECT doc_id, rank, lang FROM ranked WHERE rank <= 3"
ORACLE["q_confusion_band"] = f"WITH {SCORES} SELECT doc_id, rank, lang FROM ranked WHERE rank <= 2 OR gap <= 0.05"


def _votes(a: str, b: str) -> str:
    differ = codepages.confusable().get(frozenset((a, b)), codepages.differing(a, b))
    gains = []
    for v in sorted(differ):
        pa, pb = (codepages.CATEGORY_PREFERENCE.get(codepages.category(e, v), 0) for e in (a, b))
        gains.append((f"{v:02X}", max(pa - pb, 0), max(pb - pa, 0)))
    return f"(VALUES {_values(gains)}) v(b, a_gain, b_gain)"


ORACLE["q_confusion_votes"] = f"WITH {LATIN}, seen AS (SELECT DISTINCT doc_id, unnest(t) AS b FROM l)" + ", " + ", ".join(
    f"{pair} AS (SELECT doc_id, '{pair}' AS pair, sum(a_gain)::INTEGER AS votes_a, sum(b_gain)::INTEGER AS votes_b FROM seen JOIN {_votes(*ab)} USING (b) GROUP BY doc_id)" for pair, ab in (("latin9", ("iso8859-1", "iso8859-15")), ("mac", ("iso8859-1", "mac-roman")))
) + " " + " UNION ALL ".join(
    f"SELECT l.doc_id, '{pair}' AS pair, coalesce(votes_a, 0) AS votes_a, coalesce(votes_b, 0) AS votes_b, CASE WHEN votes_a > votes_b THEN '{a}' WHEN votes_b > votes_a THEN '{b}' END AS winner FROM l LEFT JOIN {pair} USING (doc_id)" for pair, a, b in (("latin9", "iso8859-1", "iso8859-15"), ("mac", "iso8859-1", "mac-roman"))
)
ORACLE["q_demote"] = f"WITH {LATIN} SELECT doc_id, " + ", ".join(f"{_count('x IN ' + _in(v))} = 0 AS demote_{e.replace('-', '_')}" for e, v in codepages.distinguishing().items()) + f", {_count('x IN ' + _in(codepages.tajik()))} > 0 AS promote_koi8_t FROM l"
_SUPER, _COMPAT = (f"(VALUES {_values(t.items())})" for t in (names.PREFERRED_SUPERSET, names.COMPAT_NAMES))
ORACLE["q_prefer_superset"] = f"""WITH {_DIM}, s AS (SELECT name, coalesce(p.b, name) AS preferred FROM e LEFT JOIN {_SUPER} p(a, b) ON name = p.a)
SELECT name, preferred, coalesce(c.b, name) AS compat, coalesce(k.b, preferred) AS both FROM s LEFT JOIN {_COMPAT} c(a, b) ON name = c.a LEFT JOIN {_COMPAT} k(a, b) ON preferred = k.a"""
ORACLE["q_language_names"] = f"""WITH o(name, lang) AS (VALUES {_values((e.name, e.languages[0] if len(e.languages) == 1 else None) for e in registry.REGISTRY.values())}), n(code, title) AS (VALUES {_values(names.LANGUAGES.items())})
SELECT name, lang AS language, title AS language_name, code FROM o LEFT JOIN n ON lang = code"""
ORACLE["q_is_correct"] = f"WITH {_DIM}, a(expected, detected) AS (VALUES {_values((k, v) for k, vs in names.accepted().items() for v in sorted(vs))}) SELECT expected, count(*) AS n_accepted FROM a JOIN e x ON expected = x.name JOIN e y ON detected = y.name GROUP BY expected"
ORACLE["q_lang_equiv"] = f"WITH l(x) AS (VALUES {_values((c,) for c in names.LANGUAGES)}), g(k, x) AS (VALUES {_values((k, x) for k, g in enumerate(names.LANGUAGE_GROUPS) for x in g)}) SELECT a.x AS a, b.x AS b FROM l a JOIN l b ON a.x = b.x UNION SELECT a.x, b.x FROM g a JOIN g b USING (k)"
_EURO = sorted(codepages.differing("iso8859-1", "iso8859-15") - {0xA4})
ORACLE["q_reads_alike"] = f"WITH {LATIN} SELECT doc_id, {_count('x >= ' + chr(39) + '80' + chr(39) + ' AND x <= ' + chr(39) + '9F' + chr(39))} = 0 AS cp1252, {_count('x IN ' + _in(_EURO))} = 0 AS latin9 FROM l"
ORACLE["q_transcode"] = "SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE regexp_full_match(text, '(?s)[\\x{00}-\\x{FF}]*')"
_EQUIVALENT = "(lang = found OR " + " OR ".join(f"(lang IN {g} AND found IN {g})" for g in names.LANGUAGE_GROUPS) + ")"
ORACLE["q_accuracy_by_lang"] = f"""WITH {SCORES}, j AS (SELECT x.lang, r.lang AS found FROM ranked r JOIN documents x USING (doc_id) WHERE rank = 1)
SELECT lang, grouping(lang)::INTEGER AS is_total, count(*) AS n, sum(CASE WHEN {_EQUIVALENT} THEN 1 ELSE 0 END)::BIGINT AS n_correct FROM j GROUP BY ROLLUP (lang)"""
#: What the deterministic stages make of valid UTF-8 text: what it declares, else ASCII, else UTF-8.
_SAYS = f"""(regexp_matches(s[1:2000], '(?i)<meta charset="utf-8">') AND NOT {_CUT})"""
_MIX = f"""x AS (SELECT 'documents' AS origin, text AS s FROM documents UNION ALL SELECT 'pages', html FROM pages UNION ALL SELECT 'conversations', text FROM conversations),
t AS (SELECT origin, s, regexp_extract_all(hex(encode(s)), '..') AS t FROM x),
r AS (SELECT origin, CASE WHEN {_SAYS} THEN 'utf-8' WHEN ({_ASCII}) IS NOT NULL THEN 'ascii' ELSE 'utf-8' END AS encoding,
  CASE WHEN {_SAYS} THEN 'text/html' ELSE 'text/plain' END AS mime_type,
  CASE WHEN {_SAYS} THEN 0.95 ELSE coalesce({_ASCII}, {_UTF8}) END AS confidence FROM t)"""
ORACLE["q_detect_mix"] = f"WITH {_MIX} SELECT origin, encoding, mime_type, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM r GROUP BY ALL"
ORACLE["q_detect_join_labels"] = f"WITH {DOCS}, r AS (SELECT doc_id, CASE WHEN ({_ASCII}) IS NOT NULL THEN 'ascii' ELSE 'utf-8' END AS encoding FROM d) SELECT encoding, quality, count(*) AS n, sum(toxic)::BIGINT AS n_toxic FROM r JOIN labels USING (doc_id) GROUP BY ALL"
ORACLE["q_stream_chunks"] = f"WITH {DOCS} SELECT doc_id, least(len(t), 200000)::INTEGER AS n_bytes, md5(unhex(h[1:400000])) AS content_md5 FROM d"
ORACLE["q_stream_detect"] = f"WITH {DOCS} SELECT doc_id, CASE WHEN ({_ASCII}) IS NOT NULL THEN 'ascii' ELSE 'utf-8' END AS encoding, coalesce({_ASCII}, round({_UTF8}, 6)) AS confidence FROM d"
ORACLE["q_running_bytes"] = """WITH t AS (SELECT conv_id, turn, octet_length(encode(text)) AS n FROM conversations), w AS (
  SELECT conv_id, turn, n, coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM t)
SELECT conv_id, turn, before, before + n >= 500 AS done FROM w"""
#: Plain ASCII with a plus sign may be UTF-7, which native stages can't tell.
_PLUS = f"({_ASCII}) IS NOT NULL AND {_count('x = ' + chr(39) + '2B' + chr(39))} > 0"
ORACLE["q_detect_native"] = f"WITH {DOCS} SELECT doc_id, NOT ({_PLUS}) AS decided, CASE WHEN {_PLUS} THEN NULL WHEN ({_ASCII}) IS NOT NULL THEN 'ascii' ELSE 'utf-8' END AS encoding FROM d"
ORACLE["q_detect_column"] = f"WITH p AS (SELECT page_id, regexp_extract_all(hex(encode(html)), '..') AS t FROM pages) SELECT page_id, 'utf-8' AS encoding, CASE WHEN {_CUT} THEN 'text/plain' ELSE 'text/html' END AS mime_type FROM p"
ORACLE["q_era_filter"] = f"WITH {DOCS} SELECT doc_id, 'utf-8' AS encoding, ({_ASCII}) IS NULL AS is_structural FROM d"


def _cells(values) -> str:
    return " ".join(f"{c}:{v}" for c, v in values)


def _models(encodings: list[str] | None = None) -> str:
    """mw (model, lang, enc, norm, bigram, w) and idf (bigram, idf): the trained tables, written out."""
    models = standard()
    own = [k for k, (_, e) in enumerate(models.keys) if encodings is None or e in encodings]
    rows = [(k, *models.keys[k], float(models.norms[k]), _cells((int(c), int(models.weights[k, c])) for c in models.weights[k].nonzero()[0])) for k in own]
    idf = [(_cells((int(c), int(models.idf[c])) for c in range(len(models.idf)) if models.idf[c] != 1),)]
    cut = lambda table: f"SELECT * EXCLUDE (cells, x), split_part(x, ':', 1)::INTEGER AS bigram, split_part(x, ':', 2)::INTEGER AS w FROM (SELECT *, unnest(string_split(cells, ' ')) AS x FROM {table})"
    return f"m(model, lang, enc, norm, cells) AS (VALUES {_values(rows)}), mw AS ({cut('m')}), i(cells) AS (VALUES {_values(idf)}), idf AS (SELECT bigram, w AS idf FROM ({cut('i')}))"


def _fits(source: str, size: int) -> str:
    """fit (doc_id, model, lang, enc, score): similarities of the first bytes of ``source`` to models."""
    return f"""pairs AS (SELECT doc_id, unnest(list_transform(range(1, least(len(t), {size})), lambda k: ('0x' || t[k] || t[k + 1])::INTEGER)) AS bigram FROM {source}),
weighed AS (SELECT doc_id, bigram, n * coalesce(idf, 1) AS v FROM (SELECT doc_id, bigram, count(*) AS n FROM pairs GROUP BY ALL) LEFT JOIN idf USING (bigram)),
lengths AS (SELECT doc_id, sqrt(sum(v * v)::DOUBLE) AS length FROM weighed GROUP BY doc_id),
fit AS (SELECT doc_id, model, lang, enc, sum(v * w)::DOUBLE / (norm * any_value(length)) AS score FROM weighed JOIN mw USING (bigram) JOIN lengths USING (doc_id) GROUP BY doc_id, model, lang, enc, norm)"""


ORACLE["q_encoding_scores"] = f"""WITH {LATIN}, {_models()}, {_fits('l', 16384)},
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, enc ORDER BY score DESC, model) AS nth FROM fit)
SELECT doc_id, enc AS encoding, round(score, 6) AS score, lang AS language FROM r WHERE nth = 1"""
ORACLE["q_detect_full"] = f"""WITH {DOCS}, {_models(['utf-8'])}, {_fits('d', 2048)},
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, model) AS nth FROM fit)
SELECT d.doc_id, CASE WHEN len(t) > 0 AND ({_ASCII}) IS NOT NULL THEN 'ascii' ELSE 'utf-8' END AS encoding,
       CASE WHEN len(t) = 0 THEN 0.1 ELSE coalesce({_ASCII}, round({_UTF8}, 6)) END AS confidence, r.lang AS language, 'text/plain' AS mime_type
FROM d LEFT JOIN r ON r.doc_id = d.doc_id AND nth = 1"""
