"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

Kinds: email, ip, card (Luhn), phone, and beyond these iban (mod 97) and
local_phone (a number without country code, kept only beside a context word).
Offsets are code points, ends exclusive.

Null and empty texts give no spans. Rows are handled one by one: a repeated row
gives repeated results, an empty table an empty result, and columns other than
the id and the text are never read. Spans of one kind never overlap, spans of
different kinds may. Every expression is linear in the text (possessive runs or
an anchor character), so very long texts and runs take no quadratic time. An iban
ends after its country's length, whatever upper-case words or numbers follow.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import load, per_text

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "local_phone")

# A local part, looked for leftwards from each @, and what follows the @.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])")
_IBAN_REST = re.compile(r"(?:\x20?[A-Z0-9]){11,30}+")
#: The length of a country's IBAN.
_IBAN_LENGTH = {
    country: int(n)
    for n, countries in (
        x.split(":")
        for x in (
            "15:NO", "16:BE", "18:DK FI FK FO GL NL SD", "19:MK SI", "20:AT BA EE KZ LT LU MN XK", "21:CH HR LI LV", "22:BG BH CR DE GB GE IE ME RS VA",
            "23:AE GI IL IQ OM SO TL", "24:AD CZ ES MD PK RO SA SE SK TN VG", "25:LY PT ST", "26:IS TR", "27:BI DJ FR GR IT MC MR SM", "28:AL AZ BY CY DO GT HN HU LB NI PL SV",
            "29:BR EG PS QA UA", "30:JO KW MU YE", "31:MT SC", "32:LC", "33:RU",
        )
    )
    for country in countries.split()
}
_LOCAL_PHONE = re.compile(r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9])")

#: A span's score without context, and what a context word adds.
_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.95, "local_phone": 0.4}
_BONUS = 0.2
_CONTEXT = {
    "email": re.compile(r"(?i)e-?mail|contact|write to"),
    "ip": re.compile(r"(?i)\bip\b|address|host|server"),
    "card": re.compile(r"(?i)card|visa|master|amex|credit|pay"),
    "phone": re.compile(r"(?i)phone|\btel|call|mobile|fax"),
    "iban": re.compile(r"(?i)iban|account|bank"),
    "local_phone": re.compile(r"(?i)phone|\btel|call|mobile|fax"),
}

SPANS = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
)
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
_ODD = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]


def luhn(digits: str) -> bool:
    return sum(int(d) if i % 2 == 0 else _ODD[int(d)] for i, d in enumerate(reversed(digits))) % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _ibans(text: str):
    """Spans that end where the country's length does; of other countries, at the last word end at which mod 97 holds."""
    done = 0
    for head in _IBAN.finditer(text):
        start, m = head.start(), _IBAN_REST.match(text, head.end())
        if start < done or not m:
            continue
        ends = [k + 1 for k in range(start, m.end()) if text[k] != " "]
        length = _IBAN_LENGTH.get(text[start : start + 2])
        for n in range(len(ends), 14, -1) if length is None else [length]:
            if n > len(ends) or re.match("[A-Za-z0-9]", text[ends[n - 1] : ends[n - 1] + 1]):
                continue
            if mod97(text[start : ends[n - 1]].replace(" ", "")):
                done = ends[n - 1]
                yield start, done
                break


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def propose(text: str, context_chars: int = 48) -> list[tuple[str, int, int, float]]:
    """The confirmed spans of one text as (kind, start, end, score), by kind, then start."""
    found: list[tuple[str, int, int]] = []
    if "@" in text:
        found += [("email", *s) for s in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append(("phone", *m.span()))
    found += [("iban", *s) for s in _ibans(text)]
    taken = [(s, e) for k, s, e in found if k in ("phone", "card")]
    for m in _LOCAL_PHONE.finditer(text):
        if not any(s < m.end() and m.start() < e for s, e in taken):
            found.append(("local_phone", *m.span()))
    out = []
    for kind, start, end in found:
        near = _CONTEXT[kind].search(text, max(0, start - context_chars), start) is not None
        if near or kind != "local_phone":
            out.append((kind, start, end, round(min(1.0, _SCORE[kind] + _BONUS * near), 3)))
    return out


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", context_chars: int = 48) -> DataFrame:
    """(id, spans array<struct<kind, start, end, score>>), a row for each row of df."""

    def make():
        def work(texts: list[bytes | None]) -> list[pa.Array]:
            rows = [propose(t.decode("utf-8", "replace"), context_chars) if t else [] for t in texts]
            return [pa.array([[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in r] for r in rows], _ARROW)]

        return work

    return per_text(df, [id_col], text_col, make, [T.StructField("spans", SPANS)])


def redact(text: str | None, spans: list) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    if text is None:
        return None
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= at:
            out += [text[at : s["start"]], f"[{s['kind']}]"]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def span_digest(spans: str = "spans", base: tuple[str, ...] = BASE_KINDS):
    """The columns of base kinds' counts, the digest of base spans, all spans as text, their scores in the same order, their number and the best score (0 without spans)."""
    as_text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda *kinds: F.filter(F.col(spans), lambda s: s["kind"].isin(*kinds))
    return [
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in base),
        F.sha2(as_text(of(*base)).cast("binary"), 256).alias("base_sha256"),
        as_text(F.col(spans)).alias("spans"),
        F.array_join(F.transform(spans, lambda s: F.format_string("%.2f", s["score"])), ",").alias("scores"),
        F.size(spans).cast("long").alias("n_spans"),
        F.coalesce(F.array_max(F.transform(spans, lambda s: s["score"])), F.lit(0.0)).alias("best_score"),
    ]


def op10_pii(spark, sf_dir: str) -> DataFrame:
    return find_pii(load(spark, sf_dir, "documents")).select("doc_id", *span_digest())


def _duck_spans(kind: str, pattern: str, ok: str = "true") -> str:
    """(r, kind, s, e, m) of a pattern's leftmost matches: matches and what lies between them give places."""
    return f"""SELECT r, {KINDS.index(kind)} AS kind, CAST(e - length(m) AS BIGINT) AS s, CAST(e AS BIGINT) AS e, m FROM (
  SELECT r, m, sum(length(m) + length(p)) OVER (PARTITION BY r ORDER BY i) AS e FROM (SELECT r, unnest(ms) AS m, unnest(ps[1:len(ms)]) AS p, generate_subscripts(ms, 1) AS i
    FROM (SELECT r, regexp_extract_all(t, '{pattern}') AS ms, regexp_split_to_array(t, '{pattern}') AS ps FROM d))) WHERE {ok}"""


def _op10_sql() -> str:
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn_sum = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST({digits}[-i] AS INT) ELSE (2 * CAST({digits}[-i] AS INT)) // 10 + (2 * CAST({digits}[-i] AS INT)) % 10 END))"
    base = [
        _duck_spans("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
        _duck_spans("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR TRY_CAST(p AS HUGEINT) > 255)) = 0"),
        _duck_spans("card", r"[0-9](?:[\x20-]?[0-9])+", f"length({digits}) BETWEEN 13 AND 19 AND {luhn_sum} % 10 = 0"),
        _duck_spans("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({digits}) BETWEEN 9 AND 15"),
    ]
    lengths = ", ".join(f"('{c}', {n})" for c, n in _IBAN_LENGTH.items())
    # RE2 has no word borders beyond ASCII, so what may stand beside a word is spelled out.
    begins, ends = r"(^|[^\pL\pN_])", r"([^\pL\pN_]|$)"
    context = {"email": "e-?mail|contact|write to", "ip": f"{begins}ip{ends}|address|host|server", "card": "card|visa|master|amex|credit|pay", "iban": "iban|account|bank"}
    context["phone"] = context["local_phone"] = f"phone|{begins}tel|call|mobile|fax"
    near = "CASE kind " + " ".join(f"WHEN {k} THEN regexp_matches(before, '(?i){context[name]}')" for k, name in enumerate(KINDS)) + " END"
    score = "CASE kind " + " ".join(f"WHEN {k} THEN CASE WHEN near THEN {min(1.0, _SCORE[name] + _BONUS):.2f} ELSE {_SCORE[name]:.2f} END" for k, name in enumerate(KINDS)) + " END"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
base AS ({" UNION ALL ".join(base)}),
heads AS (SELECT r, s, t[s + 1:s + 80] AS w, t FROM ({_duck_spans("iban", "[A-Z]{2}[0-9]{2}")}) JOIN d USING (r) WHERE s = 0 OR NOT regexp_matches(t[s:s], '[A-Za-z0-9]')),
runs AS (SELECT r, s, t, regexp_extract(w, '^[A-Z]{{2}}[0-9]{{2}}(?:\\x20?[A-Z0-9]){{11,30}}') AS run FROM heads),
lengths AS (SELECT * FROM (VALUES {lengths}) v(country, n)),
ends AS (SELECT r, s, t, run, unnest(range(15, length(replace(run, ' ', '')) + 1)) AS k, list_filter(range(1, length(run) + 1), lambda i: run[i] <> ' ') AS places, run[1:2] AS country FROM runs WHERE run <> ''),
tried AS (SELECT r, s, t, k, run, places[k] AS size, country FROM ends WHERE NOT regexp_matches(t[s + places[k] + 1:s + places[k] + 1], '[A-Za-z0-9]')),
summed AS (SELECT r, s, k, size, lengths.n, replace(run[1:size], ' ', '') AS x FROM tried LEFT JOIN lengths USING (country) WHERE lengths.n IS NULL OR lengths.n = k),
valid AS (SELECT r, s, s + max(size) AS e FROM summed WHERE list_reduce(list_transform(string_split(x[5:] || x[1:4], ''), lambda c: CASE WHEN c <= '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END), lambda a, v: (a * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1 GROUP BY r, s),
ibans AS (SELECT r, {KINDS.index("iban")} AS kind, s, e FROM valid v WHERE NOT EXISTS (SELECT 1 FROM valid o WHERE o.r = v.r AND o.s < v.s AND o.e > v.s)),
cores AS (SELECT r, s, e, t FROM ({_duck_spans("local_phone", r"[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}")}) JOIN d USING (r)),
locals AS (SELECT r, {KINDS.index("local_phone")} AS kind, s - CAST(s > 0 AND t[s:s] = '(' AS BIGINT) AS s, e, t FROM cores WHERE NOT regexp_matches(t[e + 1:e + 1], '[0-9]')),
spans AS (
  SELECT r, kind, s, e FROM base UNION ALL SELECT * FROM ibans
  UNION ALL SELECT r, kind, s, e FROM locals l WHERE (s = 0 OR NOT regexp_matches(t[s:s], '[0-9+(.-]')) AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = l.r AND b.kind IN (2, 3) AND b.s < l.e AND l.s < b.e)
),
seen AS (SELECT r, kind, s, e, CASE WHEN s > 48 AND regexp_matches(t[s - 48:s - 48], '[\\pL\\pN_]') THEN '_' ELSE ' ' END || t[greatest(1, s - 47):s] AS before FROM spans JOIN d USING (r)),
judged AS (SELECT *, {near} AS near FROM seen),
kept AS (SELECT *, {score} AS score, concat(list_extract({list(KINDS)!r}, kind + 1), ':', s, ':', e) AS x FROM judged WHERE kind <> {KINDS.index("local_phone")} OR near)
SELECT doc_id, {", ".join(f"count(*) FILTER (kind = {k}) AS n_{name}" for k, name in enumerate(BASE_KINDS))},
  sha256(coalesce(string_agg(x, ',' ORDER BY kind, s) FILTER (kind < {len(BASE_KINDS)}), '')) AS base_sha256, coalesce(string_agg(x, ',' ORDER BY kind, s), '') AS spans,
  coalesce(string_agg(format('{{:.2f}}', score), ',' ORDER BY kind, s), '') AS scores, count(x) AS n_spans, CAST(coalesce(max(score), 0) AS DOUBLE) AS best_score
FROM d LEFT JOIN kept USING (r) GROUP BY r, doc_id
"""


OP10_SQL = _op10_sql()
