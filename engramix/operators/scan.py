"""Searches in one pass over the documents: a document meets all queries of a block where it is read, and only its places among the best leave the task.

Postings of words that most documents and queries hold grow with their product once they are joined and shuffled. Here a batch of documents is one table
of terms, a block of queries another, and their weights are summed in the task. Queries come in blocks of ``SCANNED``, one pass over the documents each; a block's terms
are all that the driver and a task hold of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCANNED, ROWS = 500, 256
#: Pairs that a task holds before it drops those that are not among its best; stands for no date.
HELD, NEVER = 200_000, -(2**62)


def blocks(queries: DataFrame, columns: list[str]) -> list[list]:
    """The rows of the queries (query_id and ``columns``, of which the array ``terms`` is not empty) in blocks of about ``SCANNED``."""
    rows = queries.select("query_id", *columns).filter(F.size("terms") > 0)
    n = max(1, -(-rows.count() // SCANNED))
    part = F.pmod(F.xxhash64("query_id"), F.lit(n))
    return [found for b in range(n) if (found := rows.filter(part == b).collect())]


def _tools(k: int | None):
    """Functions that tasks need, as closures, so that they travel with the work."""
    import numpy as np

    def table(block):
        """The block's terms, and ``spread``, which sums weights of (row, term) for every row and query that asks for the term."""
        terms = sorted({t for r in block for t in r["terms"]})
        at, wide = {t: i for i, t in enumerate(terms)}, len(block)
        term, asks = np.array([(at[t], j) for j, r in enumerate(block) for t in r["terms"]]).T
        order = np.argsort(term, kind="stable")
        asks, many = asks[order], np.bincount(term, minlength=len(terms))
        starts = np.cumsum(many) - many

        def spread(n, row, term, weight):
            size = many[term]
            to = asks[np.repeat(starts[term] - np.cumsum(size) + size, size) + np.arange(size.sum())]
            return np.bincount(np.repeat(row, size) * wide + to, np.repeat(weight, size), n * wide).reshape(n, wide)

        return terms, spread

    def first(query, score, places, late, ids):
        """Which of the pairs may be among their query's first k: scores (rounded to ``places``) descending, ``late`` descending, ids ascending."""
        if places is None:
            place, border = score, np.zeros(len(score), bool)
        else:  # scores on a border of rounding are left to SQL's rounding
            scaled = score * 10.0**places
            place, border = np.floor(scaled + 0.5), np.abs(scaled - np.floor(scaled) - 0.5) < 1e-3
        # Equal scores on a border are rounded alike, so k of them are enough.
        fine = np.where(border, -score, 0.0)
        order = np.lexsort((ids, -late, fine, -place, border, query))
        q, p, b, f = query[order], place[order], border[order], fine[order]
        at = np.arange(len(q))
        nth = at - np.searchsorted(q, q)
        same = np.r_[False, (q[1:] == q[:-1]) & b[1:] & b[:-1] & (f[1:] == f[:-1])][: len(q)]
        alike = at - np.maximum.accumulate(np.where(same, 0, at))
        kth = ~b & (nth == k - 1)
        last = np.full(int(q.max()) + 1 if len(q) else 0, -np.inf)
        last[q[kth]] = p[kth]
        return order[np.where(b, (p >= last[q] - 1) & (alike < k), nth < k)]

    def dates(batch):
        return np.array([NEVER if x is None else x for x in batch.column("updated_s").to_pylist()], "int64")

    return table, first, dates


def _scan(docs: DataFrame, queries: list[list], work, kind: str) -> DataFrame:
    return reduce(DataFrame.unionAll, [docs.mapInArrow(work(block), kind) for block in queries])


def ranked(docs: DataFrame, queries: list[list], k: int, weights: dict[str, float], k1: float, b: float, mean: float) -> DataFrame:
    """query_id, node_id, updated_s, score (rounded) of pairs with a common term that may be among a query's k best by BM25. ``docs``: node_id, updated_s,
    ts (all tokens); ``weights``: the terms' idf; ``mean``: tokens of a document."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    table, first, dates = _tools(k)
    key = docs.schema["node_id"].dataType.simpleString()

    def work(block):
        terms, spread = table(block)
        idf, names = np.array([weights.get(t, 0.0) for t in terms]), [r["query_id"] for r in block]

        def run(batches):
            known = pa.array(terms, pa.string())
            asked, least, kind = np.array(names), np.full(len(names), -np.inf), None
            held, n_held, most = [], 0, HELD

            def cut():
                """What may still be among the best of the task's rows so far, and each query's k-th score."""
                q, ids, late, score = (np.concatenate(x) for x in zip(*held))
                keep = first(q, score, 6, late, ids)
                q, ids, late, score = q[keep], ids[keep], late[keep], score[keep]
                low, many = np.full(len(names), np.inf), np.bincount(q, minlength=len(names))
                np.minimum.at(low, q, score)
                return (q, ids, late, score), np.where(many >= k, low, -np.inf)

            for whole in batches:
                for start in range(0, whole.num_rows, ROWS):
                    batch = whole.slice(start, ROWS)
                    n, ts = batch.num_rows, batch.column("ts")
                    lens = pc.list_value_length(ts).to_numpy(zero_copy_only=False)
                    at = pc.index_in(ts.flatten(), value_set=known)
                    hit = pc.is_valid(at).to_numpy(zero_copy_only=False)
                    cells = np.repeat(np.arange(n), lens)[hit] * len(terms) + pc.fill_null(at, 0).to_numpy(zero_copy_only=False)[hit]
                    cells, tf = np.unique(cells, return_counts=True)
                    row, term = np.divmod(cells, len(terms))
                    score = spread(n, row, term, idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * lens[row] / mean)))
                    # Scores round to six places, so two units below the k-th nothing can come in.
                    i, q = np.nonzero((score != 0) & (score >= least - 2e-6))
                    late, ids, kind = dates(batch), batch.column("node_id").to_numpy(zero_copy_only=False), batch.schema.field("node_id").type
                    held.append((q, ids[i], late[i], score[i, q]))
                    n_held += len(i)
                    if n_held > most:
                        rest, least = cut()
                        held, n_held = [rest], len(rest[0])
                        most = max(HELD, 2 * n_held)
            if held:
                (q, ids, late, score), _ = cut()
                yield pa.RecordBatch.from_arrays([pa.array(asked[q]), pa.array(ids, kind), pa.array(late, mask=late == NEVER), pa.array(score)], ["query_id", "node_id", "updated_s", "score"])

        return run

    found = _scan(docs, queries, work, f"query_id bigint, node_id {key}, updated_s bigint, score double")
    return found.withColumn("score", F.round("score", 6))


def held_terms(docs: DataFrame, queries: list[list], k: int | None) -> DataFrame:
    """query_id, node_id, updated_s, n (terms that the document holds as substrings), size (the query's terms), whole (whether it holds all of ``q``).

    ``docs``: node_id, updated_s, low (the text), fields (its different fields, terms lie inside one). With ``k`` those pairs that may be among a query's k highest
    n, with size + 1 added for whole ones; without it all pairs with more than half of the terms. A batch's different fields are searched once.
    """
    import numpy as np
    import pyarrow as pa

    table, first, dates = _tools(k)
    key = docs.schema["node_id"].dataType.simpleString()

    def work(block):
        terms, spread = table(block)
        sizes, texts, names = np.array([len(r["terms"]) for r in block]), [r["q"] for r in block], [r["query_id"] for r in block]
        at_term, longer = {t: i for i, t in enumerate(terms)}, {}
        for t in terms:
            if len(t) > 3:
                longer.setdefault(t[:3], set()).add(len(t))

        def run(batches):
            asked, seen, begun = np.array(names), {}, {}

            def begins(gram):
                """The terms of three characters at most that begin like this, and how long others that do may be."""
                found = [at_term[gram[:n]] for n in (1, 2, 3) if n <= len(gram) and gram[:n] in at_term], longer.get(gram, ())
                if len(begun) < 200_000:
                    begun[gram] = found
                return found

            def inside(field):
                if (found := seen.get(field)) is None:
                    held_here = set()
                    for i in range(len(field)):
                        gram = field[i : i + 3]
                        short, lengths = begun.get(gram) or begins(gram)
                        held_here.update(short)
                        for n in lengths:
                            if (t := at_term.get(field[i : i + n])) is not None:
                                held_here.add(t)
                    found = np.fromiter(held_here, "int64", len(held_here))
                    if len(seen) < 200_000 and len(field) <= 64:  # only spares work; other fields are searched again
                        seen[field] = found
                return found

            for whole in batches:
                for start in range(0, whole.num_rows, ROWS):
                    batch = whole.slice(start, ROWS)
                    n, fields = batch.num_rows, batch.column("fields")
                    lens = np.array([len(x) for x in fields.to_pylist()])
                    coded = fields.flatten().dictionary_encode()
                    found = [inside(f) for f in coded.dictionary.to_pylist()]
                    each = np.array([len(f) for f in found], "int64")
                    flat, starts = np.concatenate([*found, np.empty(0, "int64")]), np.cumsum(each) - each
                    code = coded.indices.to_numpy(zero_copy_only=False)
                    many = each[code] if len(code) else np.empty(0, "int64")
                    at = np.repeat(starts[code] if len(code) else many, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    cells = np.unique(np.repeat(np.repeat(np.arange(n), lens), many) * len(terms) + flat[at])
                    row, term = np.divmod(cells, len(terms))
                    count = spread(n, row, term, np.ones(len(cells)))
                    i, q = np.nonzero(count if k is not None else count * 2 > sizes)
                    low, full = batch.column("low"), np.zeros(len(i), bool)
                    for x in np.flatnonzero(count[i, q] == sizes[q]):
                        full[x] = texts[q[x]] in low[int(i[x])].as_py()
                    got = count[i, q]
                    if k is not None:
                        ids = batch.column("node_id").to_numpy(zero_copy_only=False)
                        keep = first(q, got + full * (sizes[q] + 1), None, dates(batch)[i], ids[i])
                        i, q, got, full = i[keep], q[keep], got[keep], full[keep]
                    at = pa.array(i)
                    columns = [pa.array(asked[q]), batch.column("node_id").take(at), batch.column("updated_s").take(at), pa.array(got.astype("int64")), pa.array(sizes[q].astype("int64")), pa.array(full)]
                    yield pa.RecordBatch.from_arrays(columns, ["query_id", "node_id", "updated_s", "n", "size", "whole"])

        return run

    return _scan(docs, queries, work, f"query_id bigint, node_id {key}, updated_s bigint, n bigint, size bigint, whole boolean")
