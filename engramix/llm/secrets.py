"""Secret scans (operator 10): multipart credential linking, in DataFrame functions only.

Strong findings stand alone: assignments to a secret's name, access identifiers and
long hexadecimal runs. Weak parts (long mixed tokens, shorter access identifiers,
service endpoints) mean little alone. A scope is a text with its blocks of
``SCOPE`` characters: parts are joined by interval, and a weak part is
reported only where a complementary part lies within ``SCOPE`` characters:

* a token needs an access identifier (strong or weak) or a service endpoint;
* a weak identifier needs a token or an assignment (a client id beside an
  address holds no secret);
* endpoints are parts, never findings. Parts that overlap don't confirm each other.

Parts have no greatest length. Positions are code points, ends exclusive. Null and empty texts have no
findings; repeated rows give repeated results (rows are joined by a row number
written with the candidates, not by id); empty tables give empty results; other
columns of the input are not read. Findings of one start are ordered by kind as listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, regex_spans

BASE_KINDS = ["assign", "access", "hex"]
LINKED_KINDS = ["linked_token", "linked_access"]
SCOPE = 200

ASSIGN = r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*+[:=]\x20*+[\"']?[a-z0-9+/_.=-]+"
ASSIGN_VALUE = r"(?i)^(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)$"
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"[0-9a-f]{16,}+"
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}+={0,2}+(?![A-Za-z0-9+/_-])"
WEAK_ACCESS = r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{8,13}|ASIA[A-Z0-9]{12,}+|(?:key|acct|client)[_-]?id[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_-]{8,}+)(?![A-Za-z0-9])"
ENDPOINT = r"(?:https?://|jdbc:|postgres(?:ql)?://|mongodb(?:\+srv)?://|s3://)[^\s\"'<>]{4,}+"
PART_TYPE = "array<struct<kind:string,s:bigint,e:bigint>>"


def _tagged(kind: str, spans: Column) -> Column:
    rows = F.transform(spans, lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    return F.coalesce(rows, F.array().cast(PART_TYPE))


def _guarded(text: Column, guard: str, pattern: str) -> Column:
    return F.when(text.rlike(guard), regex_spans(text, pattern))


def base_spans(text: Column) -> Column:
    """Strong findings by start, then kind as listed."""
    assigned = F.filter(
        _guarded(text, r"(?i)password|passwd|secret|token|api_?key", ASSIGN),
        lambda x: F.length(F.regexp_extract(x["m"], ASSIGN_VALUE, 1)) >= 12,
    )
    found = F.concat(
        _tagged("assign", assigned),
        _tagged("access", F.when(F.contains(text, F.lit("AKIA")), regex_spans(text, ACCESS))),
        _tagged("hex", _guarded(text, HEX, HEX)),
    )
    return sort_spans(found)


def weak_parts(text: Column) -> Column:
    """Parts that count only together: tokens with letters of both cases and a digit, identifiers, endpoints."""
    mixed = lambda m: m.rlike("[a-z]") & m.rlike("[A-Z]") & m.rlike("[0-9]")
    tokens = F.filter(_guarded(text, r"[A-Za-z0-9+/_-]{24}", TOKEN), lambda x: mixed(x["m"]))
    return F.concat(
        _tagged("token", tokens),
        _tagged("weak_access", _guarded(text, r"AKIA|ASIA|[_-]?id[\"']?\x20*[:=]", WEAK_ACCESS)),
        _tagged("endpoint", _guarded(text, r"://|jdbc:", ENDPOINT)),
    )


def sort_spans(spans: Column) -> Column:
    """By start, then kind as listed."""
    rank = lambda k: F.array_position(F.array(*map(F.lit, BASE_KINDS + LINKED_KINDS)), k)
    return F.transform(F.sort_array(F.transform(spans, lambda x: F.struct(x["s"], rank(x["kind"]), x.alias("x")))), lambda o: o["x"])


def link_parts(rows: DataFrame) -> DataFrame:
    """``rid, kind, s, e`` of the weak parts that complementary parts confirm.

    ``rows`` has ``rid``, ``base`` and ``weak``. Both sides of the interval join
    are cut into blocks of ``SCOPE`` characters; a part looks into its own block and the
    neighbouring ones, so that every pair within ``SCOPE`` meets exactly once
    by the partner's block. Only whether a partner exists is kept (semi-joins),
    so rows never multiply.
    """
    strong = rows.select("rid", F.explode("base").alias("p")).select("rid", "p.*")
    weak = rows.select("rid", F.explode("weak").alias("p")).select("rid", "p.*")
    partners = (
        strong.unionByName(weak)
        .select("rid", "kind", "s", "e", F.explode(F.sequence(F.floor(F.col("s") / SCOPE), F.floor(F.col("e") / SCOPE))).alias("block"))
        .withColumnsRenamed({"kind": "p_kind", "s": "p_s", "e": "p_e"})
    )
    seekers = weak.filter(F.col("kind") != "endpoint").select(
        "*",
        F.explode(F.sequence(F.floor((F.col("s") - SCOPE) / SCOPE), F.floor((F.col("e") + SCOPE) / SCOPE))).alias("block"),
    )
    # Nothing may confirm itself, so parts that overlap don't count.
    near = (F.col("p_s") >= F.col("e")) & (F.col("p_s") - F.col("e") <= SCOPE) | (F.col("s") >= F.col("p_e")) & (F.col("s") - F.col("p_e") <= SCOPE)
    complements = ((F.col("kind") == "token") & F.col("p_kind").isin("access", "weak_access", "endpoint")) | (
        (F.col("kind") == "weak_access") & F.col("p_kind").isin("token", "assign")
    )
    joined = seekers.alias("w").join(
        partners.select(F.col("rid").alias("p_rid"), "p_kind", "p_s", "p_e", F.col("block").alias("p_block")),
        (F.col("rid") == F.col("p_rid")) & (F.col("block") == F.col("p_block")) & near & complements,
        "left_semi",
    )
    return joined.select(
        "rid", F.when(F.col("kind") == "token", "linked_token").otherwise("linked_access").alias("kind"), "s", "e"
    ).distinct()


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, ``base`` and ``spans`` (base and linked findings)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialize(
        docs.select(F.col(id_col).alias(id_col), base_spans(text).alias("base"), weak_parts(text).alias("weak")).select(
            F.monotonically_increasing_id().alias("rid"), "*"
        )
    )
    linked = link_parts(rows).groupBy("rid").agg(F.collect_list(F.struct("kind", "s", "e")).alias("linked"))
    return rows.join(linked, "rid", "left").select(
        id_col,
        "base",
        sort_spans(F.concat("base", F.coalesce("linked", F.array().cast(PART_TYPE)))).alias("spans"),
    )


def spans_string(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")
