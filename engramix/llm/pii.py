"""PII (operator 8): weak-supervision aggregation, in DataFrame functions only.

1. Candidates: spans of the four base kinds (email, ip, card, phone) and of wider
   kinds (written-out e-mail, phone without a plus, IBAN, social security number,
   card-like numbers that fail the Luhn sum).
2. Labelers vote on every candidate: +1, -1 or 0 (abstain). Regex labelers judge
   the form, a gazetteer labeler looks for cue words before the span, context
   labelers look at the characters around it.
3. Votes are counted by pattern (at most ``len(KINDS) * 3**len(LABELERS)`` groups,
   whatever the input), and expectation-maximisation over the counts estimates
   each labeler's reliabilities and the share of true spans.
4. A logistic span classifier is trained on the patterns, weighted by counts, with
   the posteriors as targets, and scores every candidate.

Base spans always stay. Others are kept where the classifier gives at least
``THRESHOLD`` and no base span overlaps them. Positions are code points, ends exclusive.

Null and empty texts have no spans; repeated rows give repeated results; empty
tables give empty results (the model is then never asked); other columns of the
input are not read. Every pattern runs in time linear in the text and without
recursion in the regex engine, so long runs of matching characters are safe.
"""

from __future__ import annotations

import functools
import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let, materialize, prefix_max, regex_spans, text_blocks

BASE_KINDS = ["email", "ip", "card", "phone"]
WIDE_KINDS = ["email_spelled", "phone_plain", "iban", "ssn", "card_unchecked"]
KINDS = BASE_KINDS + WIDE_KINDS
THRESHOLD = 0.5
#: Characters of context that the gazetteer labeler sees before a span.
CUE_WIDTH = 24
#: Words that announce personal data.
GAZETTEER = (
    "mail|email|e-mail|contact|phone|tel|telephone|mobile|fax|call|cell|card|visa|mastercard|iban|account|ssn|"
    "social security|address|kontakt|telefon|correo|courriel|tarjeta|carte|karte|konto|compte|cuenta"
)

LOCAL = r"A-Za-z0-9._%+-"
LABEL = r"A-Za-z0-9-"
# A dot that no label follows can't stand inside a domain. With such dots turned into "_"
# (in the local class too, not in the domain's), the domain is a plain run of characters.
EMAIL = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[{LABEL}]++\.[{LABEL}.]++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
# With every blank or hyphen that isn't between two digits turned into "\x01", a digit
# group with single separators is a plain run.
DIGIT_RUN = r"[0-9][\x20\-0-9]++"
LONE_SEPARATOR = r"[\x20-](?![0-9])|(?<![0-9])[\x20-]"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# With every spelled-out dot (and the blank on either side of it) turned into "\x02", and into "\x03"
# where no label follows, the domain is a plain run again.
SPELLED_DOTS = [(r"[\x02\x03]", "\x01"), (r"(?i)[\[(]dot[\])]", "\x02" * 5), (r"[\[(]\.[\])]", "\x02" * 3), (r"\x20(?=\x02)|(?<=\x02)\x20", "\x02"), (r"\x02(?!\x02*+[A-Za-z0-9-])", "\x03")]
EMAIL_SPELLED = r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++\x20?[\[(](?:at|@)[\])]\x20?[a-z0-9-]++\x02[a-z0-9\x02-]++"
PHONE_PLAIN = r"(?<![0-9A-Za-z+(])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

LABELERS = ["form", "checksum", "gazetteer", "edges", "identifier"]
EM_ROUNDS = 50
SPAN_TYPE = "array<struct<kind:string,s:bigint,e:bigint,votes:string>>"


def digits_of(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn sum."""

    def value(d: Column, i: Column) -> Column:
        n = d.cast("int")
        doubled = F.when(n > 4, n * 2 - 9).otherwise(n * 2)
        return F.when(i % 2 == 1, doubled).otherwise(n)

    places = F.transform(F.split(F.reverse(digits), ""), value)
    return F.aggregate(places, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _email_spans(text: Column) -> Column:
    found = regex_spans(F.regexp_replace(text, r"\.(?![A-Za-z0-9-])", "_"), EMAIL)
    return F.when(F.contains(text, F.lit("@")), found)


def _ip_spans(text: Column) -> Column:
    small = lambda m: F.forall(F.split(m, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))).between(0, 3) & (p.cast("decimal(38,0)") <= 255))
    return F.filter(regex_spans(text, IP), lambda x: small(x["m"]))


def _digit_runs(text: Column) -> Column:
    """Card-like runs of 13 to 19 digits."""
    spans = regex_spans(F.regexp_replace(text, LONE_SEPARATOR, "\x01"), DIGIT_RUN)
    sized = F.filter(spans, lambda x: F.length(digits_of(x["m"])).between(13, 19))
    return F.when(text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), sized)


def _phone_spans(text: Column) -> Column:
    found = F.filter(regex_spans(text, PHONE), lambda x: F.length(digits_of(x["m"])).between(9, 15))
    return F.when(F.contains(text, F.lit("+")), found)


def _spelled_spans(text: Column) -> Column:
    for pattern, mark in SPELLED_DOTS:
        text = F.regexp_replace(text, pattern, mark)
    return regex_spans(text, EMAIL_SPELLED)


def _original(blocks: Column, spans: Column) -> Column:
    """The spans with the text's own characters."""
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), cut(blocks, x["s"], x["e"] - x["s"]).alias("m")))


def mod_97(iban: Column) -> Column:
    """An IBAN's remainder: its first four characters last, letters as 10 to 35."""
    moved = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(
        F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), lambda a, c: let(value(c), lambda v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97)
    )


def _votes(kind: str, blocks: Column, x: Column) -> Column:
    """One character per labeler: p (for), n (against), z (abstains). ``blocks``: the text's (``text_blocks``)."""

    def vote(for_it: Column, against: Column) -> Column:
        return F.when(for_it, F.lit("p")).when(against, F.lit("n")).otherwise(F.lit("z"))

    yes, no = F.lit(True), F.lit(False)
    m = x["m"]
    before = F.lower(cut(blocks, F.greatest(x["s"] - CUE_WIDTH, F.lit(0)), F.least(x["s"], F.lit(CUE_WIDTH))))
    after = cut(blocks, x["e"], F.lit(1))
    digits = digits_of(m)
    if kind == "email":
        form = vote(m.rlike(r"^[A-Za-z0-9](?:.*[A-Za-z0-9])?@.*\.[A-Za-z]{2,}$"), m.rlike(r"\.\.|^[.%+-]|\.[0-9]+$"))
    elif kind == "ip":
        form = vote(~m.rlike(r"(?:^|\.)0[0-9]"), yes)
    elif kind in ("card", "card_unchecked"):
        form = vote(m.rlike(r"^[0-9]+$|^[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}$"), m.rlike(r"(?:^|[\x20-])[0-9](?:[\x20-][0-9]){5}"))
    elif kind in ("phone", "phone_plain"):
        form = vote(m.rlike(r"[() .-]") & ~m.rlike(r"[().-]{3}|^\+0"), m.rlike(r"[().-]{3}|^\+0"))
    elif kind == "email_spelled":
        form = vote(m.rlike("[A-Za-z]{2,}$"), m.rlike("[0-9]$"))
    elif kind == "iban":
        form = vote(F.regexp_replace(m, " ", "").rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"), yes)
    else:
        form = vote(yes, no)
    if kind == "card":
        checksum = vote(yes, no)
    elif kind == "card_unchecked":
        checksum = vote(no, yes)
    elif kind == "iban":
        checksum = let(mod_97(F.regexp_replace(m, " ", "")), lambda r: vote(r == 1, r != 1))
    elif kind == "ssn":
        checksum = vote(~m.rlike(r"^(?:000|666|9)|-00-|-0000$"), yes)
    elif kind in ("phone", "phone_plain"):
        checksum = vote(no, digits.rlike(r"^([0-9])\1*$"))
    else:
        checksum = vote(no, no)
    gazetteer = vote(before.rlike(rf"\b(?:{GAZETTEER})\b"), no)
    edges = vote(before.rlike(r"(?:^|[\s:;,(\[<])$") & after.rlike(r"^(?:$|[\s;,.)\]>!?])"), before.rlike(r"[\w=/]$") | after.rlike(r"^[\w/=]"))
    identifier = vote(no, before.rlike(r"(?:version|build|order|invoice|isbn|serial|id|no|ref|http\S*)[\s:#.=]*$"))
    return F.concat(form, checksum, gazetteer, edges, identifier)


def raw_spans(text: Column) -> dict[str, Column]:
    """What the patterns find, by kind: arrays of (s, e, m). ``email_spelled`` spans hold the changed text."""
    guarded = lambda guard, pattern: F.when(text.rlike(guard), regex_spans(text, pattern))
    runs = F.when(text.rlike("[0-9]"), _digit_runs(text))
    return {
        "email": _email_spans(text),
        "ip": F.when(text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), _ip_spans(text)),
        "card": runs,
        "phone": F.when(text.rlike("[0-9]"), _phone_spans(text)),
        "phone_plain": guarded(r"[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}", PHONE_PLAIN),
        "iban": guarded("[A-Z]{2}[0-9]{2}", IBAN),
        "ssn": guarded("[0-9]{3}-[0-9]{2}-[0-9]{4}", SSN),
        "email_spelled": F.when(text.rlike(r"(?i)[\[(](?:at|@)[\])]"), _spelled_spans(text)),
    }


def candidate_spans(text: Column) -> Column:
    """All candidates of a text as ``array<struct<kind, s, e, votes>>``, by kind, then start.

    Texts are cut into blocks only where a pattern found something, and contexts come from the blocks, so the
    cost is linear in a text's length and number of spans.
    """
    none = F.array().cast("array<struct<s:bigint,e:bigint,m:string>>")
    found = F.struct(*[F.coalesce(spans, none).alias(kind) for kind, spans in raw_spans(text).items()])

    def tagged(kind: str, spans: Column, blocks: Column) -> Column:
        return F.transform(spans, lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), _votes(kind, blocks, x).alias("votes")))

    def voted(raw: Column, blocks: Column) -> Column:
        runs = lambda passing: F.filter(raw["card"], lambda x: luhn(digits_of(x["m"])) == passing)
        plain = [tagged(kind, raw[kind], blocks) for kind in ("email", "ip")]
        later = [tagged(kind, raw[kind], blocks) for kind in ("phone", "phone_plain", "iban", "ssn")]
        spelled = tagged("email_spelled", _original(blocks, raw["email_spelled"]), blocks)
        return F.concat(*plain, tagged("card", runs(True), blocks), *later, tagged("card_unchecked", runs(False), blocks), spelled)

    def with_blocks(raw: Column) -> Column:
        some = [F.size(raw[kind]) > 0 for kind in ("email", "ip", "card", "phone", "phone_plain", "iban", "ssn", "email_spelled")]
        return F.when(functools.reduce(lambda a, b: a | b, some), let(text_blocks(text), lambda b: voted(raw, b))).otherwise(F.array().cast(SPAN_TYPE))

    return let(found, with_blocks)


def count_votes(candidates: DataFrame) -> list[tuple[str, str, int]]:
    """(kind, votes, count): at most ``len(KINDS) * 3**len(LABELERS)`` groups."""
    rows = candidates.select(F.explode("candidates").alias("c")).groupBy("c.kind", "c.votes").count()
    return sorted((r[0], r[1], r[2]) for r in rows.collect())


def fit_reliabilities(counts: list[tuple[str, str, int]]) -> dict[tuple[str, str], float]:
    """Posterior of "true span" for each (kind, votes), by expectation-maximisation.

    Latent class per candidate; labelers vote independently given the class. The
    start trusts majority votes, those of base kinds more than those of the wider ones; reliabilities carry pseudo-counts that
    expect a labeler to be right, so that none becomes certain and few data stay near the start. In the rounds, every kind's prior has the same pseudo-counts.
    """
    signs = {"p": 1, "n": -1, "z": 0}
    post = {(k, v): 1 / (1 + math.exp(-sum(signs[c] for c in v) - (1.5 if k in BASE_KINDS else -0.5))) for k, v, _ in counts}
    for _ in range(EM_ROUNDS if counts else 0):
        total = {1: 1.0, 0: 1.0}
        seen = {(y, j, c): 1.0 + 2.0 * (c == "p") * (y == 1) + 2.0 * (c == "n") * (y == 0) for y in (0, 1) for j in range(len(LABELERS)) for c in "pnz"}
        prior = {k: [1.0, 1.0] for k in KINDS}
        for k, v, n in counts:
            for y, p in ((1, post[k, v]), (0, 1 - post[k, v])):
                total[y] += n * p
                prior[k][y] += n * p
                for j, c in enumerate(v):
                    seen[y, j, c] += n * p
        rate = {key: x / sum(seen[key[0], key[1], c] for c in "pnz") for key, x in seen.items()}
        for k, v, _ in counts:
            odds = math.log(prior[k][1] / prior[k][0]) + sum(math.log(rate[1, j, c] / rate[0, j, c]) for j, c in enumerate(v))
            post[k, v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return post


def features(kind: str, votes: str) -> list[float]:
    signs = {"p": 1.0, "n": -1.0, "z": 0.0}
    return [1.0, *(signs[c] for c in votes), *(float(k == kind) for k in KINDS)]


def train_span_classifier(counts: list[tuple[str, str, int]], post: dict[tuple[str, str], float], rounds: int = 300) -> list[float]:
    """Weights of a logistic model of the posteriors; patterns weigh by their counts, kinds equally."""
    w = [0.0] * (1 + len(LABELERS) + len(KINDS))
    of_kind = {k: sum(n for j, _, n in counts if j == k) for k in KINDS}
    rows = [(features(k, v), post[k, v], n / of_kind[k]) for k, v, n in counts]
    scale = sum(r[2] for r in rows) or 1.0
    for _ in range(rounds):
        grad = [1e-3 * x for x in w]
        for x, y, n in rows:
            p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x))))
            for i, a in enumerate(x):
                grad[i] += n / scale * (p - y) * a
        w = [a - 2.0 * g for a, g in zip(w, grad)]
    return w


def span_score(weights: list[float], kind: Column, votes: Column) -> Column:
    """The classifier over the columns ``kind`` and ``votes``."""
    total = F.lit(weights[0])
    for j, _ in enumerate(LABELERS):
        c = F.substring(votes, j + 1, 1)
        total = total + F.when(c == "p", F.lit(weights[1 + j])).when(c == "n", F.lit(-weights[1 + j])).otherwise(F.lit(0.0))
    by_kind = F.create_map(*itertools.chain.from_iterable((F.lit(k), F.lit(weights[1 + len(LABELERS) + i])) for i, k in enumerate(KINDS)))
    return 1 / (1 + F.exp(-(total + by_kind[kind])))


def fit_span_classifier(candidates: DataFrame) -> list[float]:
    """Weights of the span classifier from ``candidates`` (candidates: array of spans)."""
    counts = count_votes(candidates)
    return train_span_classifier(counts, fit_reliabilities(counts))


def chosen_spans(candidates: Column, weights: list[float]) -> Column:
    """``array<struct<kind, s, e, score, base>>`` of the spans that stay, by kind, then start."""
    scored = F.transform(
        candidates,
        lambda c: F.struct(
            c["kind"].alias("kind"),
            c["s"].alias("s"),
            c["e"].alias("e"),
            span_score(weights, c["kind"], c["votes"]).alias("score"),
            c["kind"].isin(BASE_KINDS).alias("base"),
        ),
    )
    order = F.create_map(*itertools.chain.from_iterable((F.lit(k), F.lit(i)) for i, k in enumerate(KINDS)))
    far = 1 << 60

    def kept(spans: Column) -> Column:
        """By start: a base span before reaches over the start if the largest end so far does; one behind starts before the end if the next base start does."""
        reach = prefix_max(F.transform(spans, lambda x: F.when(x["c"]["base"], x["c"]["e"]).otherwise(F.lit(-far))))
        ahead = F.reverse(prefix_max(F.reverse(F.transform(spans, lambda x: F.when(x["c"]["base"], -x["c"]["s"]).otherwise(F.lit(-far))))))

        def free(edges: Column) -> Column:
            clear = lambda x, i: (F.get(edges["reach"], i) <= x["c"]["s"]) & (-F.get(edges["ahead"], i) >= x["c"]["e"])
            return F.filter(spans, lambda x, i: x["c"]["base"] | ((x["c"]["score"] >= THRESHOLD) & clear(x, i)))

        return let(F.struct(reach.alias("reach"), ahead.alias("ahead")), free)

    by_start = F.sort_array(F.transform(scored, lambda c: F.struct(c["s"].alias("s"), c.alias("c"))))
    ranked = F.transform(let(by_start, kept), lambda x: F.struct(order[x["c"]["kind"]].alias("k"), x["c"]["s"].alias("s"), x["c"]["e"].alias("e"), x["c"].alias("c")))
    return F.transform(F.sort_array(ranked), lambda o: o["c"])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id and ``spans`` (``array<struct<kind, s, e, score,
    base>>``, by kind, then start).

    The candidates are written once, without the texts, then read for the vote
    counts and again for the scores.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialize(docs.select(F.col(id_col).alias(id_col), candidate_spans(text).alias("candidates")))
    weights = fit_span_classifier(rows)
    return rows.select(id_col, chosen_spans(F.col("candidates"), weights).alias("spans"))


def redact_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the spans of ``text_col`` redacted; null texts stay null.

    The classifier is fitted on the candidates of all rows, which are found a
    second time where the texts are rewritten, so that no text is written or shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(candidate_spans(text).alias("candidates")).filter(F.size("candidates") > 0)
    weights = fit_span_classifier(materialize(found))
    spans = let(candidate_spans(text), lambda c: chosen_spans(c, weights))
    return docs.withColumn(text_col, F.when(F.col(text_col).isNotNull(), let(spans, lambda s: F.when(F.size(s) == 0, F.col(text_col)).otherwise(redact(F.col(text_col), s)))))


def spans_string(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def redact(text: Column, spans: Column, mark: str = "[{}]") -> Column:
    """``text`` with every span replaced by its kind; of overlapping spans the first start wins
    and the rest of the others is cut as well."""
    ordered = F.sort_array(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))
    before, after = mark.split("{}")

    def joined(x: Column) -> Column:
        """The text's gaps and the labels, each on its own: what lies before a span is known from the largest end so far."""
        until = lambda i: F.coalesce(F.when(i > 0, F.get(x["ends"], i - 1)), F.lit(0).cast("bigint"))
        label = lambda kind: F.concat(F.lit(before), F.upper(kind), F.lit(after))
        pieces = F.transform(
            x["spans"], lambda o, i: F.when(o["s"] < until(i), F.lit("")).otherwise(F.concat(cut(x["blocks"], until(i), o["s"] - until(i)), label(o["kind"])))
        )
        end = F.coalesce(F.try_element_at(x["ends"], F.lit(-1)), F.lit(0).cast("bigint"))
        return F.concat(F.array_join(pieces, ""), cut(x["blocks"], end, F.length(text) - end))

    ends = lambda o: prefix_max(F.transform(o, lambda y: y["e"]))
    return let(ordered, lambda o: let(F.struct(o.alias("spans"), ends(o).alias("ends"), text_blocks(text).alias("blocks")), joined))
