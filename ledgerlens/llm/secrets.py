"""Secret scans with multipart credential linking (operator 9, native).

Strong spans (assignments, access identifiers, long hex) are found per text by regular expressions.
Weak candidates (a bare token of 32 characters or more, plain or url-safe base64, an endpoint, an account name) mean little alone.
Every candidate spans a scope of ``reach`` code points on both sides; an interval join inside each
document links parts whose scopes meet, and a weak candidate is reported only if complementary
parts co-occur: a bare token with an identifier (access or account), an account name with a secret
(assignment, hex or token), an endpoint with both an identifier and a secret.

The interval join is an equality join on (document, cell): cells are ``reach`` wide, each part is put
into the cells its scope touches (at most three), so no pairs of distant parts are made and a long document
spreads over many cells. Texts never leave their row: only spans are exploded, and only of documents
that hold a weak candidate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.tables import written

# The patterns of the strong kinds, as the contract states them (either case for the words).
ASSIGN = ("([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"
          "[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = "AKIA[A-Z0-9]+"
#: Runs are maximal, so asking for 16 characters at once gives the runs that reach 16.
HEXRUN = "[0-9a-f]{16,}"
# Weak kinds.
TOKEN = "(?<![A-Za-z0-9+/=])(?=[A-Za-z/+]*[0-9])(?=[0-9/+]*[A-Za-z])[A-Za-z0-9+/]{32,}={0,2}(?![A-Za-z0-9+/=])"
URL_TOKEN = "(?<![A-Za-z0-9_=-])(?=[A-Za-z_-]*[0-9])(?=[0-9_-]*[A-Za-z])[A-Za-z0-9_-]{32,}={0,2}(?![A-Za-z0-9_=-])"
ENDPOINT = "(?:https?|jdbc:[a-z]+|postgres|postgresql|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9._~:@/?%&=+-]{4,}"
ACCOUNT = "(?:[Uu][Ss][Ee][Rr](?:[Nn][Aa][Mm][Ee])?|[Ll][Oo][Gg][Ii][Nn]|[Cc][Ll][Ii][Ee][Nn][Tt]_?[Ii][Dd])[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9._@-]{2,}"
# Order of kinds where spans start together.
KINDS = ["assign", "access", "hex", "token", "endpoint", "account"]
WEAK = ["token", "endpoint", "account"]
SPAN = "array<struct<start:int,ord:int,end:int>>"
REACH = 200


def regex_spans(text, pattern: str, kind: str, keep=None):
    """Leftmost non-overlapping matches of ``pattern`` as (start, ord, end) in code points.

    The pieces between matches and the matches themselves alternate, so running lengths give the
    positions. ``keep``: from a match's text to a condition; failing matches are dropped afterwards.
    Most texts have no match and are settled by one search.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern)
    rows = F.aggregate(
        F.sequence(F.lit(1), F.size(matches)),
        F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {SPAN})").alias("spans")),
        lambda s, i: _step(s, F.element_at(pieces, i), F.element_at(matches, i), KINDS.index(kind), keep))
    return F.when(text.rlike(pattern), rows["spans"]).otherwise(F.expr(f"cast(array() as {SPAN})"))


def _step(state, piece, match, order, keep):
    start = state["at"] + F.length(piece)
    end = start + F.length(match)
    span = F.array(F.struct(start.alias("start"), F.lit(order).alias("ord"), end.alias("end")))
    added = F.concat(state["spans"], span)
    if keep is not None:
        added = F.when(keep(match), added).otherwise(state["spans"])
    return F.struct(end.alias("at"), added.alias("spans"))


def kind_name(order):
    return F.element_at(F.array(*[F.lit(k) for k in KINDS]), order + 1)


def span_text(spans):
    """``kind:start:end`` by start, then kind in the listed order, joined by commas."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", kind_name(s["ord"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def candidate_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, base, weak): strong and weak spans of each row of ``docs``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    long_value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 12
    base = F.concat(regex_spans(text, ASSIGN, "assign", long_value),
                    regex_spans(text, ACCESS, "access", lambda m: F.length(m) >= 18),
                    regex_spans(text, HEXRUN, "hex"))
    weak = F.array_distinct(F.concat(*[regex_spans(text, p, k) for k, p in (
        ("token", TOKEN), ("token", URL_TOKEN), ("endpoint", ENDPOINT), ("account", ACCOUNT))]))
    return docs.select(F.col(id_col).alias("doc_id"), F.md5(text.cast("binary")).alias("text_key"),
                       base.alias("base"), weak.alias("weak"))


def linked_weak(spans: DataFrame, reach: int = REACH) -> DataFrame:
    """(doc_id, text_key, linked): per document the weak spans whose complementary parts co-occur.

    A bare token that lies inside a strong span is that span and no weak candidate; one inside a longer bare
    token (the two alphabets) is that token.
    """
    inside = lambda w, x: (w["ord"] == x["ord"]) & (x["start"] <= w["start"]) & (w["end"] <= x["end"]) & (w != x)
    parts = (spans.where(F.size("weak") > 0).select("doc_id", "text_key", "base", F.filter("weak", lambda w: ~F.exists(
        "base", lambda b: (w["start"] < b["end"]) & (b["start"] < w["end"]))).alias("weak")).distinct()
        .withColumn("weak", F.filter("weak", lambda w: ~F.exists("weak", lambda x: inside(w, x))))
        .select("doc_id", "text_key", F.explode(F.concat("base", "weak")).alias("s"))
        .select("doc_id", "text_key", F.col("s.start").alias("start"), F.col("s.ord").alias("ord"), F.col("s.end").alias("end"),
                kind_name(F.col("s.ord")).alias("kind")))
    is_id, is_secret = F.col("kind").isin("access", "account"), F.col("kind").isin("assign", "hex", "token")
    weak = (parts.where(F.col("kind").isin(*WEAK))
            .select("*", F.explode(F.sequence(((F.col("start") - reach) / reach).cast("int"), (F.col("end") / reach).cast("int") + 1)).alias("cell")))
    whole = parts.where(is_id | is_secret).select(
        F.col("doc_id").alias("d2"), F.col("text_key").alias("t2"), F.col("start").alias("s2"), F.col("end").alias("e2"),
        F.col("kind").alias("k2"), is_secret.alias("secret2"),
        F.explode(F.sequence((F.col("start") / reach).cast("int"), (F.col("end") / reach).cast("int"))).alias("cell2"))
    near = ((F.col("s2") <= F.col("end") + reach) & (F.col("e2") >= F.col("start") - reach) & (F.col("kind") != F.col("k2")))
    linked = (weak.join(whole, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("text_key") == F.col("t2"))
                        & (F.col("cell") == F.col("cell2")) & near)
              .groupBy("doc_id", "text_key", "start", "ord", "end", "kind")
              .agg(F.bool_or("secret2").alias("with_secret"), F.bool_or(~F.col("secret2")).alias("with_id"))
              .where(F.when(F.col("kind") == "token", F.col("with_id")).when(F.col("kind") == "account", F.col("with_secret"))
                     .otherwise(F.col("with_secret") & F.col("with_id"))))
    return (linked.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "ord", "end")).alias("linked")))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """(doc_id, text_key, base, added): strong spans and linked weak spans for every row of ``docs``.

    Spans are structs (start, ord, end): code points, end exclusive, ``ord`` an index into ``KINDS``.
    Null and empty texts have no spans. Repeated rows are each reported, also under a null id. Other
    columns are not read. An empty table gives an empty result.
    """
    spans = written(candidate_spans(docs, id_col, text_col), "secret-spans")
    links = linked_weak(spans, reach).select(F.col("doc_id").alias("d3"), F.col("text_key").alias("t3"), "linked")
    return (spans.join(links, F.col("doc_id").eqNullSafe(F.col("d3")) & (F.col("text_key") == F.col("t3")), "left")
            .select("doc_id", "text_key", "base", F.coalesce("linked", F.expr(f"cast(array() as {SPAN})")).alias("added")))


def masked_text(text, spans, mask: str = "[SECRET]"):
    """``text`` with every span replaced by ``mask``; overlapping spans become one."""
    merged = F.aggregate(
        F.array_sort(spans), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda s, x: F.when(x["end"] <= s["at"], s).otherwise(F.struct(
            x["end"].alias("at"),
            F.concat(s["out"], F.when(x["start"] >= s["at"], F.concat(
                F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit(mask))).otherwise(F.lit(""))).alias("out"))))
    return F.when(F.size(spans) == 0, text).otherwise(
        F.concat(merged["out"], F.substring(text, merged["at"] + 1, F.length(text))))


def mask_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The rows of ``docs``, all columns, with every strong and linked weak span of the text replaced by ``mask``."""
    found = (scan_secrets(docs, id_col, text_col).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.concat("base", "added").alias("_spans"))
             .where(F.size("_spans") > 0).dropDuplicates(["_id", "_key"]))
    text = F.col(text_col).cast("string")
    keyed = docs.withColumn("_text_key", F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    joined = keyed.join(found, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key")), "left")
    masked = F.when(F.col("_spans").isNull(), text).otherwise(masked_text(text, F.col("_spans"), mask))
    return joined.withColumn(text_col, masked).select(*docs.columns)
