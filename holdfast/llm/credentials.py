"""Multipart credential linking, in DataFrame functions only.

Base spans (assignments, access identifiers, long hexadecimal runs) are always
reported.  Weak candidates - account names, long mixed tokens, endpoint
addresses - are reported only where complementary parts co-occur: an account
name or a token needs the other one near it, an endpoint needs both.

Within a scope (one document row) the parts are intervals of start positions,
widened by ``reach``.  The interval join runs over cells of width ``reach``:
every cell keeps only the least and the greatest start of each role, so a weak
part meets nine rows at most, however many parts a scope has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, set_apart

# Fixed values of the contract: kinds in order, their patterns and least lengths.
ASSIGN = (r"""(?:(?i)(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
          r"([A-Za-z0-9+/_.=-]+)")
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
# Weak kinds.
ACCOUNT = (r"""(?:(?i)(?:client_?id|user_?name|user|login|account))["']?\x20*[:=]\x20*["']?"""
           r"[A-Za-z0-9_.@+-]{3,}")
TOKEN = r"[A-Za-z0-9+/_-]{32,}"
ENDPOINT = (r"(?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://"
            r"""[^\x20\x09-\x0D"'<>]+""")

KINDS = ("assign", "access", "hex", "account", "secret", "endpoint")
_ROLE = {"assign": "secret", "hex": "secret", "access": "account",
         "account": "account", "secret": "secret", "endpoint": "endpoint"}
_SPAN = "array<struct<start:long,kind:int,end:long,role:string,keep:boolean>>"


def _spans(text: Column, kind: str, pattern: str, keep_if=None) -> Column:
    """Leftmost non-overlapping matches as spans in code points.

    ``split`` gives the text between the matches, so every start is the sum of
    the lengths before it; lengths of Spark strings count code points.
    """
    role, order = _ROLE[kind], KINDS.index(kind)
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"),
                         F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    empty = F.array().cast(_SPAN)

    def add(acc, x):
        start = acc["at"] + F.char_length(x["gap"])
        end = start + F.char_length(x["hit"])
        ok = x["hit"].isNotNull() if keep_if is None else x["hit"].isNotNull() & keep_if(x["hit"])
        one = F.array(F.struct(start.cast("long").alias("start"), F.lit(order).alias("kind"),
                               end.cast("long").alias("end"), F.lit(role).alias("role"),
                               F.lit(kind in KINDS[:3]).alias("keep")))
        return F.struct(F.coalesce(end, start).cast("long").alias("at"),
                        F.when(ok, F.concat(acc["out"], one.cast(_SPAN)))
                        .otherwise(acc["out"]).alias("out"))

    found = F.aggregate(parts, F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out")),
                        add, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), found).otherwise(empty)


def parts_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the spans of all kinds: ``__base`` and ``__weak``.  Weak
    spans wholly inside a base span are left out; others may overlap it."""
    t = F.coalesce(F.col(text), F.lit(""))
    base = F.array_sort(F.concat(
        _spans(t, "assign", ASSIGN,
               keep_if=lambda h: F.char_length(F.regexp_extract(h, ASSIGN, 1)) >= 6),
        _spans(t, "access", ACCESS), _spans(t, "hex", HEX)))
    weak = F.concat(
        _spans(t, "account", ACCOUNT),
        _spans(t, "secret", TOKEN, keep_if=lambda h: h.rlike("[0-9]") & h.rlike("[A-Za-z]")),
        _spans(t, "endpoint", ENDPOINT))
    free = F.filter("__all", lambda w: ~F.exists(
        "__base", lambda b: (b["start"] <= w["start"]) & (w["end"] <= b["end"])))
    return (docs.withColumn("__base", base).withColumn("__all", weak)
            .withColumn("__weak", F.array_sort(free)).drop("__all"))


def linked(parts: DataFrame, reach: int) -> DataFrame:
    """``(__row, __added)``: weak spans with their complementary parts near.

    ``parts`` has __row, __base and __weak.  Near: starts at most ``reach``
    code points apart.
    """
    spans = (parts.filter(F.size("__weak") > 0)
             .select("__row", F.explode(F.concat("__base", "__weak")).alias("p"))
             .select("__row", "p.*")
             .withColumn("cell", F.expr(f"start div {reach}")))
    seen = spans.groupBy("__row", "cell", F.col("role").alias("other")).agg(
        F.min("start").alias("least"), F.max("start").alias("greatest"))
    weak = (spans.filter(~F.col("keep"))
            .select("__row", "start", "kind", "end", "role",
                    F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1))
                    .alias("cell")))
    near = weak.join(seen, ["__row", "cell"]).filter(
        (F.col("greatest") >= F.col("start") - reach) & (F.col("least") <= F.col("start") + reach))
    has = (near.groupBy("__row", "start", "kind", "end", "role")
           .agg(*[F.max(F.col("other") == r).alias(f"has_{r}") for r in ("account", "secret")]))
    complete = (F.when(F.col("role") == "account", F.col("has_secret"))
                .when(F.col("role") == "secret", F.col("has_account"))
                .otherwise(F.col("has_secret") & F.col("has_account")))
    return has.filter(complete).groupBy("__row").agg(
        F.collect_list(F.struct("start", "kind", "end")).alias("__added"))


def scan(docs: DataFrame, reach: int = 400, text: str = "text") -> DataFrame:
    """``docs`` with ``__base`` and ``__spans`` (base and linked weak spans),
    each an array of (start, kind, end) in order; kinds index :data:`KINDS`.

    Every row is a scope of its own, also a repeated one.  A null text counts
    as empty; null ids do not matter; an empty table gives no row; all other
    columns stay as they are.  Texts are scanned whole.
    """
    kept = materialize(parts_of(docs, text)
                       .withColumn("__row", F.monotonically_increasing_id()), "credential_parts")
    plain = lambda c: F.transform(c, lambda s: F.struct(s["start"], s["kind"], s["end"]))
    none = F.array().cast("array<struct<start:long,kind:int,end:long>>")
    return (kept.join(linked(kept, reach), "__row", "left")
            .withColumn("__base", plain("__base"))
            .withColumn("__spans", F.array_sort(F.concat(
                "__base", F.coalesce("__added", none))))
            .drop("__row", "__added", "__weak"))


def shown(spans: str) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, reach: int = 400, doc_id: str = "doc_id",
           text: str = "text") -> DataFrame:
    """Per document the numbers of base spans, their digest, and all spans."""
    count = lambda k: F.size(F.filter("__base", lambda s: s["kind"] == KINDS.index(k))).cast("long")
    found = scan(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), reach)
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(shown("__base"), 256).alias("base_sha256"), shown("__spans").alias("spans"))


def redact(docs: DataFrame, marker: str = "[REDACTED]", reach: int = 400,
           text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """``docs`` with every found span replaced by ``marker``; overlapping
    spans become one.  Texts without a span stay as they are."""
    docs, back = set_apart(docs, text, length)
    found = scan(docs, reach, text)

    def add(acc, s):
        inside = s["start"] < acc["at"]
        gap = F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], gap, F.lit(marker)))
            .alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    new = F.aggregate("__spans", start, add, lambda acc: F.concat(
        acc["out"], F.substring(F.col(text), acc["at"] + 1, F.char_length(F.col(text)))))
    out = found.withColumn(text, F.when(F.size("__spans") > 0, new).otherwise(F.col(text)))
    if length and length in docs.columns:
        out = out.withColumn(length, F.when(
            F.size("__spans") > 0, F.char_length(text)).otherwise(F.col(length))
            .cast(docs.schema[length].dataType))
    return back(out.select(*[F.col(f"`{c}`") for c in docs.columns]))
