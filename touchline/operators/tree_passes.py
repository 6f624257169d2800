"""Forests and boosters over all rows of a table too large for one task: every level of all trees is one pass of tasks.

Rows lie in blocks: those of one fold in one stretch of the order of a hash of the match, with their bins as bytes. A pass
leads the rows of each block through the trees as far as they have grown, and adds up what the next cuts need, by node,
feature and bin, inside the task. One sum for each task and tree is shuffled; a forest's cuts are chosen where its sums meet
(at most ``NODES`` nodes at a time), a booster's on the driver. Borders of bins are
exact quantiles of all rows of the fold, from counts of distinct values in range partitions. Same borders, draws and cuts as
``trees.fit_forest`` and ``trees.fit_boosted`` on the same rows; a booster's sums are added in another order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators import trees
from touchline.operators.trees import BINS, Boosted, Forest
from touchline.session import SETTLED, few_rows_a_file, remove_settled, settle

#: Rows of a stretch: each tree's bootstrap draws are dealt to stretches, then drawn inside them.
STRETCH_ROWS = 16_384
#: Nodes of a level whose sums meet in one group.
NODES = 1024
#: Blocks that a task holds at a time.
HELD = 64
#: Rounds of a booster after which the sums of its trees are written beside the rows.
KEPT_ROUNDS = 20
#: Sums of all tasks that are added up on the driver; more are added up in tasks.
DRIVER_BYTES = 32 << 20
#: Blocks in a file, and so at a time in a reader.
FILE_BLOCKS = 16


def _picked(parts: DataFrame, totals: dict, asked: dict) -> dict:
    """{(fold, feature, rank): (value, values below it)} of the asked ranks (from 0) among the fold's values that are not missing."""
    local: dict = {}
    for (fold, j), ranks in asked.items():
        ends = np.cumsum([n for _, n in totals[fold, j]])
        for rank in set(ranks):
            i = int(np.searchsorted(ends, rank, side="right"))
            local.setdefault((totals[fold, j][i][0], j), []).append((fold, rank, int(ends[i] - totals[fold, j][i][1])))
    shared = parts.sparkSession.sparkContext.broadcast(local)

    def pick(table: pa.Table) -> pa.Table:
        out = {n: [] for n in ("fold", "j", "rank", "below", "value")}
        part, j = table["part"][0].as_py(), table["j"][0].as_py()
        table = table.sort_by("v")
        value, count, keys = table["v"].to_numpy(), table["n"].to_numpy(), table["key"].combine_chunks().dictionary_encode()
        names, of = keys.dictionary.to_pylist(), keys.indices.to_numpy()
        for fold in {f for f, *_ in shared.value.get((part, j), [])}:
            own = np.flatnonzero(np.isin(of, [i for i, name in enumerate(names) if str(fold) in name.split(",")]))
            held, ends = value[own], np.cumsum(count[own])
            for k, rank, offset in shared.value[part, j]:
                if k == fold:
                    at = int(np.searchsorted(ends, rank - offset, side="right"))
                    first = int(np.searchsorted(held, held[at]))
                    for n, v in zip(out, (fold, j, rank, offset + (int(ends[first - 1]) if first else 0), float(held[at]))):
                        out[n].append(v)
        return pa.table({"fold": pa.array(out["fold"], pa.int64()), "j": pa.array(out["j"], pa.int32()), "rank": pa.array(out["rank"], pa.int64()),
                         "below": pa.array(out["below"], pa.int64()), "value": pa.array(out["value"], pa.float64())})

    got = parts.groupBy("part", "j").applyInArrow(pick, "fold long, j int, rank long, below long, value double").collect()  # a row for a rank
    return {(r.fold, r.j, r["rank"]): (r.value, r.below) for r in got}


def fold_borders(rows: DataFrame, width: int) -> dict:
    """{fold: what ``trees.fit_borders`` gives for its rows}; ``rows`` has ``x`` and the ``folds`` of each row."""
    keyed = rows.select(F.concat_ws(",", "folds").alias("key"), "x")
    sizes: dict = {}
    for r in keyed.groupBy("key").count().collect():  # a row for each set of folds
        for k in map(int, r.key.split(",")):
            sizes[k] = sizes.get(k, 0) + r["count"]
    known = keyed.select("key", F.posexplode("x").alias("j", "v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    parts = settle(known.groupBy("key", "j", "v").agg(F.count(F.lit(1)).alias("n")).repartitionByRange("j", "v").withColumn("part", F.spark_partition_id()))
    totals: dict = {}
    for r in parts.groupBy("j", "part", "key").agg(F.sum("n").alias("n")).orderBy("j", "part").collect():  # a row for each part and set of folds
        for k in map(int, r.key.split(",")):
            held = totals.setdefault((k, r.j), [])
            if held and held[-1][0] == r.part:
                held[-1] = (r.part, held[-1][1] + r.n)
            else:
                held.append((r.part, r.n))
    known_rows = {key: sum(n for _, n in held) for key, held in totals.items()}
    middle = _picked(parts, totals, {key: [(n - 1) // 2, n // 2] for key, n in known_rows.items()})
    fill, below, asked = {}, {}, {}
    for (k, j), n in known_rows.items():
        low, high = middle[k, j, (n - 1) // 2], middle[k, j, n // 2]
        fill[k, j], below[k, j] = (low[0] + high[0]) / 2, low[1] if low[0] == high[0] else n // 2
        missing = sizes[k] - n
        places = np.floor((sizes[k] - 1) * np.linspace(0, 1, BINS + 1)[1:-1]).astype(np.int64)
        # the missing values stand at the median, after the values below it
        asked[k, j] = [None if below[k, j] <= i < below[k, j] + missing else int(i if i < below[k, j] else i - missing) for i in places]
    got = _picked(parts, totals, {key: [i for i in ranks if i is not None] + [known_rows[key] - 1] for key, ranks in asked.items()})
    out = {}
    for k in sizes:
        cuts = np.full((width, BINS - 1), np.inf)
        for j in range(width):
            if (k, j) in asked:
                own = np.unique([fill[k, j] if i is None else got[k, j, i][0] for i in asked[k, j]])
                own = own[own < got[k, j, known_rows[k, j] - 1][0]]
                cuts[j, :len(own)] = own
        out[k] = np.array([fill.get((k, j), 0.0) for j in range(width)]), cuts
    return out


def _blocks(rows: DataFrame, borders: dict, total: int) -> DataFrame:
    """(fold, stretch, n, y, bins): the rows of each fold and stretch in the order of the hash; bins of one feature after the other."""
    stretches = -(-total // STRETCH_ROWS)
    place = F.shiftright((F.shiftright("at", 32) + F.lit(1 << 31)) * F.lit(stretches), 32)
    shared = rows.sparkSession.sparkContext.broadcast(borders)

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("at", "ascending"), ("match_id", "ascending")])
        x = table["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(table.num_rows, -1)
        y, members = table["y"].to_numpy().astype(np.int8), table["folds"].combine_chunks()
        of = np.repeat(np.arange(table.num_rows), np.diff(members.offsets.to_numpy()))
        flat, out = members.flatten().to_numpy(), []
        for k in np.unique(flat).tolist():
            own = of[flat == k]
            out.append((k, table["stretch"][0].as_py(), len(own), y[own].tobytes(), np.ascontiguousarray(trees.to_bins(x[own], *shared.value[k]).T).tobytes()))
        columns = zip(*out)
        return pa.table({n: pa.array(list(c), t) for (n, t), c in zip(
            (("fold", pa.int64()), ("stretch", pa.int32()), ("n", pa.int32()), ("y", pa.binary()), ("bins", pa.binary())), columns)})

    made = rows.withColumn("stretch", place.cast("int")).groupBy("stretch").applyInArrow(pack, "fold long, stretch int, n int, y binary, bins binary")
    return made.repartitionByRange(_tasks(rows, stretches * len(borders)), "fold", "stretch")


def _tasks(rows: DataFrame, blocks: int) -> int:
    return max(1, min(blocks, max(rows.sparkSession.sparkContext.defaultParallelism, blocks // HELD)))


def _held(batches: Iterator[pa.RecordBatch], names: tuple) -> Iterator[list[dict]]:
    """A few blocks at a time."""
    held: list[dict] = []
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(n)[i] for n in names}
            held.append({"fold": row["fold"].as_py(), "stretch": row["stretch"].as_py(), "n": row["n"].as_py(),
                         "y": np.frombuffer(row["y"].as_buffer(), np.int8).astype(np.int64),
                         "bins": np.frombuffer(row["bins"].as_buffer(), np.uint8).reshape(-1, row["n"].as_py()),
                         **({"z": np.frombuffer(row["z"].as_buffer(), np.float64)} if "z" in row else {})})
            if len(held) >= HELD:
                yield held
                held = []
    if held:
        yield held


_ROWS = ("fold", "stretch", "n", "y", "bins")


def _led(block: dict, weight: np.ndarray, levels: list) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a block that reach the tree's open level, and their nodes there; a level gives its features and cuts."""
    rows = np.flatnonzero(weight)
    node, flat, n = np.zeros(len(rows), np.int64), block["bins"].ravel(), block["n"]
    for feature, cut in levels:
        split = feature >= 0
        child = np.where(split, 2 * (np.cumsum(split) - split), -1)
        if not split.all():
            keep = split[node]
            rows, node = rows[keep], node[keep]
        node = child[node] + (np.take(flat, feature.astype(np.int64)[node] * n + rows) > cut[node])
    return rows, node


def _grown_forests(blocks: DataFrame, specs: dict, sizes: dict, borders: dict, width: int) -> dict:
    """{(fold, name): Trees} of every forest; a job for each level."""
    if any(s.depth < 1 for s in specs.values()):
        raise ValueError("a forest needs a level of cuts")
    per_node = max(1, int(np.sqrt(width)))
    # levels that are cut, class shares of the open level
    state = {(k, name, t): ([], None) for name, s in specs.items() for k in sizes for t in range(s.trees)}
    made = {key: trees._Nodes(3) for key in state}
    spark = blocks.sparkSession
    counted = spark.sparkContext.broadcast({(k, name): [trees.draws(s, t, sizes[k]) for t in range(s.trees)] for name, s in specs.items() for k in sizes})
    for level in range(max(s.depth for s in specs.values())):
        live = {key: own for key, own in state.items() if specs[key[1]].depth > level}
        if not live:
            break
        order = list(live)
        nodes = [1 if own[1] is None else len(own[1]) for own in live.values()]
        shared = spark.sparkContext.broadcast((order, [own[0] for own in live.values()], nodes))

        def count(batches: Iterator[pa.RecordBatch], shared=shared, level=level) -> Iterator[pa.RecordBatch]:
            order, levels, nodes = shared.value
            for held in _held(batches, _ROWS):
                present = {b["fold"] for b in held}
                for i, (k, name, t) in enumerate(order):
                    if k not in present:
                        continue
                    spec, m = specs[name], nodes[i]
                    drawn, parts = np.ascontiguousarray(trees.level_features(spec, t, level, m, width).T), []
                    for block in held:
                        if block["fold"] == k:
                            weight = trees.bootstrap(spec, t, block["stretch"], block["n"], counted.value[k, name][t][block["stretch"]], len(sizes[k]) == 1)
                            rows, node = _led(block, weight, levels[i])
                            flat = block["bins"].ravel()
                            parts.append((node, block["y"][rows], weight[rows].astype(float), np.stack([
                                np.take(flat, np.take(drawn[j], node) * block["n"] + rows) for j in range(per_node)])))
                    node, y, own, bins = (np.concatenate(c, -1) for c in zip(*parts))
                    ends = [len(node)]
                    if m > NODES:
                        by_node = np.argsort(node, kind="stable")
                        node, y, own, bins = node[by_node], y[by_node], own[by_node], bins[:, by_node]
                        ends = np.searchsorted(node, np.arange(NODES, m + NODES, NODES))
                    for c, (start, end) in enumerate(zip([0, *ends], ends)):
                        most = min(NODES, m - c * NODES)
                        base = (y[start:end] * most + node[start:end] - c * NODES) * BINS
                        values = np.concatenate([np.bincount(base + b[start:end], own[start:end], 3 * most * BINS) for b in bins])
                        cells = np.flatnonzero(values)
                        dense = 2 * len(cells) > len(values)
                        yield pa.RecordBatch.from_pydict({
                            "tree": pa.array([i], pa.int32()), "chunk": pa.array([c], pa.int32()),
                            "cells": pa.array([b"" if dense else cells.astype(np.int32).tobytes()], pa.binary()),
                            "counts": pa.array([(values if dense else values[cells]).astype(np.uint32).tobytes()], pa.binary())})

        def cut(table: pa.Table) -> pa.Table:
            order, _, nodes = shared.value
            i, c = table["tree"][0].as_py(), table["chunk"][0].as_py()
            _, name, t = order[i]
            spec, m = specs[name], min(NODES, nodes[i] - c * NODES)
            drawn = trees.level_features(spec, t, level, nodes[i], width)[c * NODES:c * NODES + m]
            sums = np.zeros(per_node * 3 * m * BINS)
            for cells, counts in zip(table["cells"], table["counts"]):
                values = np.frombuffer(counts.as_buffer(), np.uint32)
                if len(cells.as_buffer()):
                    sums[np.frombuffer(cells.as_buffer(), np.int32)] += values
                else:
                    sums += values
            left = sums.reshape(per_node, 3, m, BINS).transpose(1, 2, 0, 3).cumsum(3)
            share = left[:, :, 0, -1].T
            best, top = trees.best_cuts(left, share, spec.least)
            fine = top > (share ** 2).sum(1) / np.maximum(share.sum(1), 1) + 1e-9
            begun = left.transpose(1, 0, 2, 3).reshape(m, 3, -1)[np.arange(m), :, best]
            return pa.table({"tree": pa.array([i], pa.int32()), "chunk": pa.array([c], pa.int32()), **{
                n: pa.array([v.astype(kind).tobytes()], pa.binary()) for n, kind, v in (
                    ("feature", np.int16, np.where(fine, drawn[np.arange(m), best // BINS], -1)), ("cut", np.uint8, np.where(fine, best % BINS, 0)),
                    ("share", np.uint32, share), ("begun", np.uint32, begun))}})

        got = blocks.mapInArrow(count, "tree int, chunk int, cells binary, counts binary").groupBy("tree", "chunk").applyInArrow(
            cut, "tree int, chunk int, feature binary, cut binary, share binary, begun binary").toArrow().to_pylist()
        found: dict = {}
        for r in sorted(got, key=lambda r: (r["tree"], r["chunk"])):
            found.setdefault(r["tree"], []).append(r)
        shared.unpersist()
        for i, key in enumerate(order):
            m = nodes[i]
            feature, at_cut = np.full(m, -1, np.int64), np.zeros(m, np.int64)
            share, begun = np.zeros((m, 3)), np.zeros((m, 3))
            for r in found.get(i, []):
                own = slice(r["chunk"] * NODES, min(m, (r["chunk"] + 1) * NODES))
                feature[own], at_cut[own] = np.frombuffer(r["feature"], np.int16), np.frombuffer(r["cut"], np.uint8)
                share[own], begun[own] = (np.frombuffer(r[n], np.uint32).reshape(-1, 3) for n in ("share", "begun"))
            share = share if state[key][1] is None else state[key][1]
            made[key].add(feature, at_cut, share / np.maximum(share.sum(1), 1)[:, None])
            split = feature >= 0
            after = np.stack([begun[split], share[split] - begun[split]], 1).reshape(-1, 3)
            state[key] = (state[key][0] + [(feature.astype(np.int16), at_cut.astype(np.uint8))], after)
            if not split.any() or len(state[key][0]) == specs[key[1]].depth:
                if split.any():  # the last level has no cuts
                    made[key].add(np.full(len(after), -1), np.zeros(len(after), np.int64), after / np.maximum(after.sum(1), 1)[:, None])
                del state[key]
    return {(k, name): trees._collected([made[k, name, t].done() for t in range(s.trees)], *borders[k], np.zeros(3), False)
            for name, s in specs.items() for k in sizes}


def _stepped(bins: np.ndarray, levels: list) -> np.ndarray:
    """Place of each row in the level after the given ones, of 2 ** levels places; a level has features and cuts by place, -1
    where there is no cut: its rows keep to the left."""
    place = np.zeros(bins.shape[1], np.uint8)
    for feature, cut in levels:
        right = np.zeros(bins.shape[1], bool)
        for i in np.flatnonzero(feature >= 0).tolist():
            right |= (bins[feature[i]] > cut[i]) & (place == i)
        place = place * np.uint8(2) + right
    return place


def _summed(block: dict, place: int, pending: list) -> np.ndarray:
    """Sums of a booster's trees for the rows of a block, a row a class: those written beside it, and ``pending`` ones."""
    z = block["z"].reshape(-1, 3, block["n"])[place].copy()
    for i, (levels, value) in enumerate(pending):
        z[i % 3] += value[_stepped(block["bins"], levels)]
    return z


def _gradient_sums(batches: Iterator[pa.RecordBatch], shared, names: list) -> Iterator[pa.RecordBatch]:
    """Sums of slopes, curvatures and rows by place, feature and bin, of each growing tree: at its root, or over the smaller of
    two children, by the place of their parent."""
    growing, pending, grown, smaller = shared.value
    sums, first = {}, 0
    for held in _held(batches, (*_ROWS, "z")):
        for block in held:
            first = first or (block["fold"] << 32) + block["stretch"] + 1
            bins, pairs = block["bins"], trees._pairs(block["bins"].astype(np.uint16))
            for key in [key for key in pending if key[0] == block["fold"]]:
                z = _summed(block, names.index(key[1]), pending[key])
                p = np.exp(z - z.max(0))
                p /= p.sum(0)
                for c in range(3):
                    i = growing.get((key, c))
                    if i is None:
                        continue
                    g, h = p[c] - (block["y"] == c), p[c] * (1 - p[c])
                    if (key, c) in smaller:
                        small, cut = smaller[key, c]
                        place = _stepped(bins, grown[key, c])
                        rows = np.flatnonzero((small == np.arange(2)[:, None]).T.ravel()[place] & np.repeat(cut, 2)[place])
                        own = trees._histograms(pairs[:, rows], len(bins), place[rows].astype(np.int64) >> 1, len(cut), g[rows], h[rows], None)
                    else:
                        own = trees._histograms(pairs, len(bins), np.zeros(block["n"], np.int64), 1, g, h, None)
                    sums[i] = sums[i] + own if i in sums else own
    for i, own in sums.items():
        yield pa.RecordBatch.from_pydict({"fit": pa.array([i], pa.int32()), "first": pa.array([first], pa.int64()), "sums": pa.array([own.tobytes()], pa.binary())})


def _added(table: pa.Table) -> pa.Table:
    table = table.sort_by("first")  # in the same order each time
    total = sum(np.frombuffer(s.as_buffer(), np.float64) for s in table["sums"])
    return pa.table({"fit": table["fit"].slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})


def _newton_cuts(sums: np.ndarray, total: np.ndarray, spec: Boosted) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature (-1: none) and bin of the best cut of each place, and slopes, curvatures and rows of the places after it."""
    m = sums.shape[1]
    lg, lh, ln = left = sums.cumsum(3)[:, :, :, :-1]
    g, h, n = (t[:, None, None] for t in total)
    gain = lg ** 2 / (lh + 1e-9) + (g - lg) ** 2 / (h - lh + 1e-9)
    gain[(ln < spec.least) | (n - ln < spec.least)] = -1
    best = gain.reshape(m, -1).argmax(1)
    fine = gain.reshape(m, -1)[np.arange(m), best] > total[0] ** 2 / (total[1] + 1e-9) + 1e-9
    begun = np.where(fine, left.reshape(3, m, -1)[:, np.arange(m), best], 0.0)
    after = np.stack([begun, np.where(fine, total - begun, 0.0)], 2).reshape(3, 2 * m)
    return np.where(fine, best // (BINS - 1), -1), np.where(fine, best % (BINS - 1), 0), after


def _tree_of(levels: list, totals: list, spec: Boosted) -> tuple[np.ndarray, list]:
    """Steps of the places after the last level, and the tree's nodes as ``trees.newton_tree`` gives them."""
    nodes, real, step = trees._Nodes(1), np.ones(1, bool), np.zeros(1)
    for level, total in enumerate(totals):
        value = -spec.step * total[0] / (total[1] + 1e-9)
        step = np.where(real, value, step)
        feature, cut = levels[level] if level < len(levels) else (np.full(len(real), -1), np.zeros(len(real), np.int64))
        if real.any():
            nodes.add(feature[real], cut[real], value[real][:, None])
        if level < len(levels):
            real, step = np.repeat(feature >= 0, 2), np.repeat(step, 2)
    return step, nodes.done()


def _grown_boosters(blocks: DataFrame, specs: dict, sizes: dict, borders: dict, width: int) -> dict:
    """{(fold, name): Trees} of every booster; a job for each level of a round, the three classes side by side."""
    names, spark = list(specs), blocks.sparkSession
    if any(not 1 <= s.depth <= 7 for s in specs.values()):
        raise ValueError("places of a level are held in a byte: 1 to 7 levels of cuts")

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, y in zip(batch.column("fold").to_pylist(), batch.column("y")):
                yield pa.RecordBatch.from_pydict({"fold": pa.array([k] * 3, pa.int64()), "label": pa.array([0, 1, 2], pa.int32()),
                                                  "n": pa.array(np.bincount(np.frombuffer(y.as_buffer(), np.int8), minlength=3), pa.int64())})

    shares = {k: np.zeros(3) for k in sizes}
    for r in blocks.mapInArrow(classes, "fold long, label int, n long").groupBy("fold", "label").agg(F.sum("n").alias("n")).collect():  # three a fold
        shares[r.fold][r.label] = r.n
    prior = {k: np.log((own + 1e-3) / (own.sum() + 3e-3)) for k, own in shares.items()}
    made, pending = ({(k, name): [] for name in names for k in sizes} for _ in range(2))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("z", pa.array([np.repeat(np.tile(prior[k], len(names)), n).tobytes() for k, n in zip(
                batch.column("fold").to_pylist(), batch.column("n").to_pylist())], pa.binary()))

    schema = "fold long, stretch int, n int, y binary, bins binary, z binary"
    held, own = settle(blocks.mapInArrow(begin, schema)), SETTLED[-1]
    tasks = held.rdd.getNumPartitions()
    for done in range(max(s.rounds for s in specs.values())):
        if done and done % KEPT_ROUNDS == 0:
            earlier, shared = own, spark.sparkContext.broadcast(pending)

            def forward(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                for blocks in _held(batches, (*_ROWS, "z")):
                    for b in blocks:
                        z = np.stack([_summed(b, i, shared.value[b["fold"], name]) for i, name in enumerate(names)])
                        yield pa.RecordBatch.from_pydict({
                            "fold": pa.array([b["fold"]], pa.int64()), "stretch": pa.array([b["stretch"]], pa.int32()), "n": pa.array([b["n"]], pa.int32()),
                            "y": pa.array([b["y"].astype(np.int8).tobytes()], pa.binary()), "bins": pa.array([b["bins"].tobytes()], pa.binary()),
                            "z": pa.array([z.tobytes()], pa.binary())})

            held, own = settle(held.mapInArrow(forward, schema)), SETTLED[-1]
            remove_settled(spark, [earlier])
            pending = {key: [] for key in made}
        live = [key for key in made if specs[key[1]].rounds > done]
        levels, totals, parents = {(key, c): [] for key in live for c in range(3)}, {}, {}
        for level in range(max(specs[key[1]].depth for key in live)):
            asked = [t for t in levels if specs[t[0][1]].depth > level and (level == 0 or (levels[t][-1][0] >= 0).any())]
            if not asked:
                break
            # of two children the one of fewer rows is summed, the other has the rest
            smaller = {t: (totals[t][-1][2].reshape(-1, 2).argmin(1), levels[t][-1][0] >= 0) for t in asked} if level else {}
            shared = spark.sparkContext.broadcast(({t: i for i, t in enumerate(asked)}, {key: pending[key] for key in live}, levels, smaller))
            parts = held.mapInArrow(lambda batches, shared=shared: _gradient_sums(batches, shared, names), "fit int, first long, sums binary")
            if tasks * len(asked) * max(1, 1 << level >> 1) * 3 * width * BINS * 8 > DRIVER_BYTES:
                fresh = {r["fit"]: r["sums"] for r in parts.groupBy("fit").applyInArrow(_added, "fit int, sums binary").toArrow().to_pylist()}
            else:  # one sum for each task and tree
                own_parts = parts.toArrow()
                fresh = {i: _added(own_parts.filter(pc.equal(own_parts["fit"], i)))["sums"][0].as_py() for i in range(len(asked))}
            fresh = {i: np.frombuffer(b, np.float64).reshape(3, -1, width, BINS) for i, b in fresh.items()}
            shared.unpersist()
            for i, t in enumerate(asked):
                sums = fresh[i]
                if level == 0:
                    totals[t] = [sums[:, :, 0].sum(2)]
                else:
                    (small, cut), at = smaller[t], np.arange(sums.shape[1])
                    sums = np.zeros((3, 2 * len(at), width, BINS))
                    sums[:, 2 * at + small], sums[:, 2 * at + 1 - small] = fresh[i], parents[t] - fresh[i]
                    sums[:, np.repeat(~cut, 2)] = 0
                feature, cut, after = _newton_cuts(sums, totals[t][-1], specs[t[0][1]])
                levels[t].append((feature, cut))
                totals[t].append(after)
                parents[t] = sums
        for key in live:
            for c in range(3):
                step, nodes = _tree_of(levels[key, c], totals[key, c], specs[key[1]])
                made[key].append(nodes)
                pending[key].append((levels[key, c], step))
    remove_settled(spark, [own])
    return {(k, name): trees._collected(made[k, name], *borders[k], prior[k], True) for name in names for k in sizes}


def fit_many(rows: DataFrame, total: int, specs: dict, columns: list) -> dict:
    """{(fold, name): Trees} of every spec on all ``rows`` (at, match_id, y, x, folds) of every fold."""
    start = len(SETTLED)
    rows = settle(rows)
    borders = fold_borders(rows, len(columns))
    with few_rows_a_file(rows.sparkSession, FILE_BLOCKS):
        made = _fitted(settle(_blocks(rows, borders, total)), total, specs, borders, len(columns))
    remove_settled(rows.sparkSession, SETTLED[start:])
    return made


def _fitted(blocks: DataFrame, total: int, specs: dict, borders: dict, width: int) -> dict:
    sizes = {k: np.zeros(-(-total // STRETCH_ROWS), np.int64) for k in borders}
    for r in blocks.select("fold", "stretch", "n").collect():  # a row for each block
        sizes[r.fold][r.stretch] = r.n
    made = {}
    for grow, kind in ((_grown_forests, Forest), (_grown_boosters, Boosted)):
        own = {n: s for n, s in specs.items() if isinstance(s, kind)}
        made |= grow(blocks, own, sizes, borders, width) if own else {}
    return made
