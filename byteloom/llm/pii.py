"""Personal data in texts, by Spark's own functions alone.

For each kind a regular expression proposes spans and a validator confirms them: parts of at most 255 for IP addresses,
the Luhn sum for card numbers, the number of digits for phone numbers. Those are the base spans. The method adds spans
of further kinds: IBANs, confirmed by their remainder modulo 97, and national identity numbers of the form
123-45-6789. Each span's score starts from its kind's prior and what its validator proves, and rises by CONTEXT_WEIGHT
where a word that goes with the kind stands within CONTEXT_CHARS characters before or after it; added spans need a
score of THRESHOLD, base spans stay whatever their score.

Positions are code points, ends exclusive. Matches are found by ``regexp_extract_all``; what lies between them, by
``split`` on the same pattern, says where each one starts. All loops in the patterns are possessive and runs start where
a run or the last match begins, which changes no match but keeps time linear and the stack flat on any text.

Nulls and edge cases: a null text is an empty one and has no spans; equal starts are ordered as the kinds are listed;
repeated rows give equal results; an empty table gives no rows. Columns are passed on; those that an operator adds
replace input columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from byteloom.llm.common import fresh

#: Base kinds in the order in which they are listed, then those that the method adds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
#: A number of at most 255 with any zeros before it; zeros alone are one too.
_LOCAL, _OCTET = "A-Za-z0-9._%+-", "(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?+)|0++)"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
}
#: What a text must hold for the kind's pattern to be worth running.
HINTS = {"email": r"@", "ip": r"\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}", "ssn": r"[0-9]-[0-9]{2}-[0-9]"}
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.4}
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write)\b",
    "ip": r"(?i)\b(?:ip|host|server|address)\b",
    "card": r"(?i)\b(?:card|credit|debit|visa|mastercard|payment)\b",
    "phone": r"(?i)\b(?:tel|phone|call|fax|mobile)\b",
    "iban": r"(?i)\b(?:iban|bank|account|transfer)\b",
    "ssn": r"(?i)\b(?:ssn|social security|insurance number)\b",
}
CONTEXT_CHARS, CONTEXT_WEIGHT, THRESHOLD = 40, 0.2, 0.6
#: Matches whose positions are summed up together.
BLOCK = 128
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "iban": "[IBAN]", "ssn": "[SSN]"}
SPAN = "struct<start:int,kind:int,end:int,score:double>"


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of at most 19 digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(number), "(?<=[0-9])(?=[0-9])"), lambda d, i: d.cast("int") * (i % 2 + 1))
    return F.aggregate(each, F.lit(0), lambda total, d: (total + d - F.when(d > 9, 9).otherwise(0)).cast("int")) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN (without spaces) leaves remainder 1 modulo 97 after its first four characters move to the end."""
    moved = F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4))
    codes = F.transform(F.split(moved, "(?<=[A-Z0-9])(?=[A-Z0-9])"), lambda c: F.ascii(c))
    step = lambda r, c: F.when(c >= 65, r * 100 + c - 55).otherwise(r * 10 + c - 48) % 97
    return F.aggregate(codes, F.lit(0), lambda r, c: step(r, c).cast("int")) == 1


def confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"\A{_OCTET}(?:\.{_OCTET}){{3}}\z")
    if kind == "card":
        return F.length(digits(match)).between(14, 19) & luhn(digits(match))
    if kind == "phone":
        return F.length(digits(match)).between(10, 15)
    if kind == "iban":
        plain = F.replace(match, F.lit(" "), F.lit(""))
        return F.length(plain).between(15, 34) & mod97(plain)
    return F.lit(True)


def _ends(sizes: Column) -> Column:
    """Running sums. Two levels, as appending to one array copies it each time."""
    none = F.array().cast("array<int>")

    def running(values: Column, since: Column) -> Column:
        zero = F.struct(since.alias("at"), none.alias("out"))
        step = lambda acc, v: F.struct((acc["at"] + v).alias("at"), F.concat(acc["out"], F.array(acc["at"] + v)).alias("out"))
        return F.aggregate(values, zero, step, lambda acc: acc["out"])

    parts = F.transform(F.sequence(F.lit(0), F.size(sizes) - 1, F.lit(BLOCK)), lambda at: F.slice(sizes, at + 1, F.lit(BLOCK)))
    held = F.array(F.struct(parts.alias("parts"), running(F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda x, y: x + y)), F.lit(0)).alias("sums")))
    ends = F.transform(held, lambda h: F.transform(h["parts"], lambda p, i: running(p, F.when(i > 0, F.get(h["sums"], i - 1)).otherwise(F.lit(0)))))
    return F.when(F.size(sizes) > 0, F.flatten(F.flatten(ends))).otherwise(none)


def _matches(kind: str, text: Column) -> Column:
    """Every match with its start, confirmed or not, and what surrounds it."""
    # An array of one element binds what is used more than once, so each pattern runs once to split and once to extract.
    found = F.array(F.struct(F.split(text, PATTERNS[kind], -1).alias("gaps"), F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)).alias("found")))
    sized = F.transform(found, lambda f: F.struct(f["gaps"].alias("gaps"), f["found"].alias("found"), _ends(F.transform(f["found"], lambda m, i: F.length(m) + F.length(F.get(f["gaps"], i)))).alias("ends")))

    def match(f: Column, m: Column, i: Column) -> Column:
        before, after = F.get(f["gaps"], i), F.get(f["gaps"], i + 1)
        return F.struct(m.alias("match"), (F.get(f["ends"], i) - F.length(m)).alias("start"), F.right(before, F.lit(CONTEXT_CHARS)).alias("before"), F.left(after, F.lit(CONTEXT_CHARS)).alias("after"))

    return F.flatten(F.transform(sized, lambda f: F.transform(f["found"], lambda m, i: match(f, m, i))))


def spans_of(kind: str, text: Column) -> Column:
    """The confirmed spans of one kind as an array of (start, kind, end, score), by start."""
    number = KINDS.index(kind)

    def span(m: Column) -> Column:
        near = m["before"].rlike(CONTEXT[kind]) | m["after"].rlike(CONTEXT[kind])
        score = F.least(F.lit(1.0), F.lit(PRIOR[kind]) + F.when(near, CONTEXT_WEIGHT).otherwise(0.0))
        return F.struct(m["start"].alias("start"), F.lit(number).alias("kind"), (m["start"] + F.length(m["match"])).alias("end"), score.alias("score"))

    spans = F.transform(F.filter(_matches(kind, text), lambda m: confirmed(kind, m["match"])), span)
    if kind not in BASE:
        spans = F.filter(spans, lambda s: s["score"] >= THRESHOLD)
    return F.when(text.rlike(HINTS[kind]), spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def detect(docs: DataFrame, text_col: str = "text", output: str = "spans") -> DataFrame:
    """Adds ``output``: all spans of a text as (start, kind, end, score), by start and then kind; ``kind`` indexes KINDS."""
    text, parts = F.coalesce(F.col(text_col).cast("string"), F.lit("")), fresh(docs, *(f"_{k}" for k in KINDS))
    kept = [c for c in docs.columns if c != output]
    by_kind = docs.select(*kept, *[spans_of(k, text).alias(n) for k, n in zip(KINDS, parts)])
    return by_kind.select(*kept, F.array_sort(F.concat(*parts)).alias(output))


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Replaces every span in ``text_col`` by its kind's label; of spans that overlap, the first to start stands for all.

    The text is cut where each BLOCK of spans ends, and spans are replaced within those parts, so time grows with the
    text's length rather than with its product with the number of spans.
    """
    spans, text = fresh(docs, "_spans")[0], F.col(text_col)
    labels = F.array(*[F.lit(LABELS[k]) for k in KINDS])
    cut = "struct<since:int,start:int,kind:int>"  # the text from ``since`` to ``start``, then a label

    def add(acc: Column, s: Column) -> Column:
        more = F.array(F.struct(acc["at"].alias("since"), s["start"].alias("start"), s["kind"].alias("kind")))
        return F.struct(F.when(s["start"] >= acc["at"], F.concat(acc["cuts"], more)).otherwise(acc["cuts"]).alias("cuts"), F.greatest(acc["at"], s["end"]).alias("at"))

    def add_block(acc: Column, part: Column) -> Column:
        done = F.aggregate(part, F.struct(F.array().cast(f"array<{cut}>").alias("cuts"), acc["at"].alias("at")), add)
        more = F.array(F.struct(acc["at"].alias("since"), done["at"].alias("until"), done["cuts"].alias("cuts")))
        return F.struct(F.concat(acc["blocks"], more).alias("blocks"), done["at"].alias("at"))

    def replaced(block: Column) -> Column:
        held = F.array(F.substring(text, block["since"] + 1, block["until"] - block["since"]))
        one = lambda own, c: F.concat(F.substring(own, c["since"] - block["since"] + 1, c["start"] - c["since"]), F.get(labels, c["kind"]))
        return F.array_join(F.transform(held, lambda own: F.array_join(F.transform(block["cuts"], lambda c: one(own, c)), "")), "")

    parts = F.transform(F.sequence(F.lit(0), F.size(spans) - 1, F.lit(BLOCK)), lambda at: F.slice(spans, at + 1, F.lit(BLOCK)))
    zero = F.struct(F.array().cast(f"array<struct<since:int,until:int,cuts:array<{cut}>>>").alias("blocks"), F.lit(0).alias("at"))
    blocks = F.aggregate(parts, zero, add_block, lambda acc: acc["blocks"])
    last = F.array_max(F.transform(spans, lambda s: s["end"]))
    plain = F.concat(F.array_join(F.transform(blocks, replaced), ""), F.substring(text, last + 1, F.length(text)))
    found = detect(docs.withColumn(text_col, text.cast("string")), text_col, spans)
    return found.withColumn(text_col, F.when(F.size(spans) > 0, plain).otherwise(text)).select(*docs.columns)
