"""Secret scans by linking the parts of a credential, in DataFrame functions only.

A credential has parts of three roles: an identifier (access, user), a secret
(assign, hex, key40) and an endpoint. Strong kinds (assign, access, hex) are
reported alone. Weak kinds, which are common in harmless text, are reported only
where their complement lies in the same scope, with at most `scope` code points
between the end of one part and the start of the other, however long the parts:
key40 beside an identifier, user beside a secret, endpoint beside both.

Positions come from two functions that agree on a pattern's leftmost matches:
regexp_extract_all gives the matches, split the texts between them; running sums
of lengths give offsets in code points. The interval join of parts is a pair of
frames over a row's parts in order of position: of each role, the furthest end among
parts that start no later, and the next start among those that start no earlier. So
it is linear in the parts, and all parts of one row are in one place anyway. Parts
are shuffled by a row number, so no key is hot; what is kept of a row goes with its
first part only.

Null and empty texts have no spans. Each row is scanned by itself: repeated rows
repeat their result, null ids are kept, an empty table gives an empty result.
Other columns are not read by scan(); redact() keeps them. Spans of one kind
never overlap; spans of different kinds may.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import load, quoted

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "key40", "user", "endpoint")
#: Code points between the parts of one credential at most.
SCOPE = 200

# The base patterns. Lengths that fail are dropped after matching, where that makes a difference.
_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_ACCESS = r"AKIA[A-Z0-9]{12,}"
_HEX = r"[0-9a-f]{32,}"
_KEY40 = r"(?<![A-Za-z0-9+/=])(?![0-9a-f]{40})[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"
_USER = r"""(?i:user(?:_?name)?|login|client_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""
_ENDPOINT = r"""(?i:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[^\s"'<>]{4,}"""


def _parts(text: Column, kind: str, pattern: str, only_if: Column, ok=None) -> Column:
    """array<struct<kind, before, length, ok>>: for each match the code points since the last one, its own, and whether it counts."""
    matches, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    found = F.zip_with(
        matches,
        between,
        lambda m, p: F.struct(F.lit(KINDS.index(kind)).alias("kind"), F.length(p).alias("before"), F.length(m).alias("length"), (F.lit(True) if ok is None else ok(m)).alias("ok")),
    )
    return F.when(only_if, found).otherwise(F.array().cast("array<struct<kind:int,before:int,length:int,ok:boolean>>"))


def _scanned(df: DataFrame, keep: list[Column], text: Column, scope: int) -> DataFrame:
    """__row, a struct of `keep`, and spans array<struct<start, kind, end, done>>, sorted; done: the furthest end of the spans before."""
    has_word = text.rlike(r"(?i)passw|secret|token|api_?key")
    has_access, has_hex = text.contains("AKIA"), text.rlike("[0-9a-f]{32}")
    flags = df.select(F.struct(*keep).alias("__row"), text.alias("__t"), has_word.alias("__w"), has_access.alias("__a"), has_hex.alias("__h"), F.monotonically_increasing_id().alias("__n"))
    t, secret = F.col("__t"), F.col("__w") | F.col("__h")
    parts = F.concat(
        _parts(t, "assign", _ASSIGN, F.col("__w"), lambda m: F.length(F.regexp_extract(m, _ASSIGN, 2)) >= 8),
        _parts(t, "access", _ACCESS, F.col("__a")),
        _parts(t, "hex", _HEX, F.col("__h")),
        _parts(t, "key40", _KEY40, secret | F.col("__a") | t.rlike("(?i)user|login|client_?id")),
        _parts(t, "user", _USER, t.rlike("(?i)user|login|client_?id")),
        _parts(t, "endpoint", _ENDPOINT, t.contains("://")),
    )
    each = flags.select("__n", "__row", F.posexplode_outer(parts).alias("__pos", "__part"))
    first = F.when(F.coalesce("__pos", F.lit(0)) == 0, F.col("__row"))
    rows = each.select("__n", first.alias("__row"), "__pos", "__part.*").repartition("__n")
    before = Window.partitionBy("__n", "kind").orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.withColumn("end", F.sum(F.col("before") + F.coalesce("length", F.lit(0))).over(before))
    placed = ends.withColumn("start", F.col("end") - F.col("length")).withColumn("ok", F.coalesce(F.col("ok") & F.col("length").isNotNull(), F.lit(False)))
    is_kind = lambda *kinds: F.col("ok") & F.col("kind").isin(*(KINDS.index(k) for k in kinds))
    # Parts of one start are peers in either direction.
    so_far = lambda order: Window.partitionBy("__n").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)

    def role(*kinds: str) -> Column:
        last_end = F.max(F.when(is_kind(*kinds), F.col("end"))).over(so_far(F.col("start").asc()))
        next_start = F.min(F.when(is_kind(*kinds), F.col("start"))).over(so_far(F.col("start").desc()))
        return F.coalesce(last_end >= F.col("start") - scope, F.lit(False)) | F.coalesce(next_start <= F.col("end") + scope, F.lit(False))

    linked = placed.withColumns({"__id": role("access", "user"), "__secret": role("assign", "hex", "key40")})
    reported = is_kind(*BASE_KINDS) | (is_kind("key40") & F.col("__id")) | (is_kind("user") & F.col("__secret")) | (is_kind("endpoint") & F.col("__id") & F.col("__secret"))
    earlier = Window.partitionBy("__n").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    done = linked.withColumn("__reported", reported).withColumn("__done", F.coalesce(F.max(F.when(F.col("__reported"), F.col("end"))).over(earlier), F.lit(0)))
    span = F.when(F.col("__reported"), F.struct(F.col("start").cast("long").alias("start"), F.col("kind"), F.col("end").cast("long").alias("end"), F.col("__done").cast("long").alias("done")))
    return done.groupBy("__n").agg(F.first("__row", ignorenulls=True).alias("__row"), F.array_sort(F.collect_list(span)).alias("spans")).drop("__n")


def scan(df: DataFrame, keep: list[str], text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """The columns `keep` (none of them named spans) and spans array<struct<start, kind, end>> (kind as its place in KINDS), sorted; a row for each row of df."""
    found = _scanned(df, [quoted(c).alias(f"c{k}") for k, c in enumerate(keep)], quoted(text_col).cast("string"), scope)
    bare = F.transform("spans", lambda s: F.struct(s["start"], s["kind"], s["end"]))
    return found.select(*(F.col(f"__row.c{k}").alias(c) for k, c in enumerate(keep)), bare.alias("spans"))


def redact(df: DataFrame, text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """df with each reported span of the text replaced by [SECRET]; touching and overlapping spans become one. n_chars, where there is one, is counted anew. Columns may have any names."""
    text, own = quoted(text_col).cast("string"), [quoted(c).alias(f"c{k}") for k, c in enumerate(df.columns)]
    # Texts that no pattern can match stay where they are; only the others' rows are shuffled.
    may = F.coalesce(text.rlike(r"(?i)passw|secret|token|api_?key|user|login|client_?id|AKIA|[0-9a-f]{32}"), F.lit(False))
    found = _scanned(df.where(may), own, text, scope)
    doc = lambda c: F.col(f"__row.c{df.columns.index(c)}")
    t = doc(text_col).cast("string")
    # Each span gives what lies between it and the spans before it, and a mark unless it touches them.
    between = lambda start, end: F.substring(t, start.cast("int") + 1, (end - start).cast("int"))
    piece = lambda s: F.when((s["start"] > s["done"]) | (s["done"] == 0), F.concat(between(s["done"], s["start"]), F.lit("[SECRET]"))).otherwise("")
    over = F.array_max(F.transform("spans", lambda s: s["end"]))
    new = F.when(F.size("spans") > 0, F.concat(F.array_join(F.transform("spans", piece), ""), between(over, F.length(t).cast("long"))))
    found = found.withColumn("__new", new)
    fields = {c: doc(c) for c in df.columns} | {text_col: F.coalesce(F.col("__new").cast(df.schema[text_col].dataType), doc(text_col))}
    if "n_chars" in df.columns:
        fields["n_chars"] = F.coalesce(F.length("__new").cast(df.schema["n_chars"].dataType), doc("n_chars"))
    return df.where(~may).unionByName(found.select(*(v.alias(c) for c, v in fields.items())))


def _is(kind: int):
    # A second parameter of a lambda would be the element's index.
    return lambda s: s["kind"] == kind


def span_digest(spans: str = "spans") -> list[Column]:
    """The columns of base kinds' counts, the digest of base spans, and all spans as text."""
    names = F.array(*map(F.lit, KINDS))
    as_text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter(spans, lambda s: s["kind"] < len(BASE_KINDS))
    return [
        *(F.size(F.filter(spans, _is(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(BASE_KINDS)),
        F.sha2(as_text(base).cast("binary"), 256).alias("base_sha256"),
        as_text(F.col(spans)).alias("spans"),
    ]


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    return scan(load(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", *span_digest())


def _duck_spans(kind: str, pattern: str, ok: str = "true") -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT r, {KINDS.index(kind)} AS kind, CAST(e - length(m) AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM (
  SELECT r, m, sum(length(m) + length(p)) OVER (PARTITION BY r ORDER BY i) AS e FROM (SELECT r, unnest(ms) AS m, unnest(ps[1:len(ms)]) AS p, generate_subscripts(ms, 1) AS i
    FROM (SELECT r, regexp_extract_all(t, '{p}') AS ms, regexp_split_to_array(t, '{p}') AS ps FROM d))) WHERE {ok}"""


# RE2 has no look-around: a key40 is a whole run of its characters and '=' that has 40 of them, no '=' and something beyond hexadecimal.
OP6_SQL = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),\nparts AS ("
    + "\nUNION ALL ".join(
        [
            _duck_spans("assign", _ASSIGN, "length(regexp_extract(m, '" + _ASSIGN.replace("'", "''") + "', 2)) >= 8"),
            _duck_spans("access", _ACCESS), _duck_spans("hex", _HEX),
            _duck_spans("key40", "[A-Za-z0-9+/=]+", "length(m) = 40 AND NOT contains(m, '=') AND NOT regexp_full_match(m, '[0-9a-f]+')"),
            _duck_spans("user", _USER), _duck_spans("endpoint", _ENDPOINT.replace(r"\s", r"\x20\x09-\x0D")),
        ]
    )
    + f"""),
near AS (SELECT a.r, a.kind, a.s, a.e, bool_or(b.kind IN (1, 4)) AS id, bool_or(b.kind IN (0, 2, 3)) AS secret FROM parts a JOIN parts b ON a.r = b.r AND b.s - a.e <= {SCOPE} AND a.s - b.e <= {SCOPE} GROUP BY ALL),
spans AS (SELECT * FROM near WHERE kind < 3 OR kind = 3 AND id OR kind = 4 AND secret OR kind = 5 AND id AND secret),
named AS (SELECT *, concat(list_extract({list(KINDS)!r}, kind + 1), ':', s, ':', e) AS x FROM spans)
SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  sha256(coalesce(string_agg(x, ',' ORDER BY s, kind) FILTER (kind < 3), '')) AS base_sha256, coalesce(string_agg(x, ',' ORDER BY s, kind), '') AS spans
FROM d LEFT JOIN named USING (r) GROUP BY r, doc_id
"""
)
