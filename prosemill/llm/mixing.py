"""Mixing sources to target weights by hierarchical budgeting.

A token budget flows down a tree of columns (domain, language, source). At each
node it is shared among the children by weight; a child that cannot use its
share (its supply times the most epochs) leaves the rest to its siblings, and
only what no sibling can use reaches the ancestors' siblings. A leaf with budget
B takes its documents floor(B / supply) times and then, of one more epoch, the
longest prefix of a seeded order that fits. Every prefix is a cut in the seeded
key, found by sums over ever narrower key ranges, so no leaf and no list of its
ranges is gathered in one task.

Defined results: null text has no tokens; null tree values are leaves of their
own (""); documents with equal keys (repeated ids) are taken together; a leaf
without tokens takes nothing; weights not given are 1; other columns stay as
they are, whatever their names (where one is called as a column added here, the
added one has a _ behind it); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, saved


def share_out(budget: int, weights: list[float], room: list[int]) -> list[int]:
    """Whole tokens for each child: by weight, at most its room, what one leaves going to the others by weight."""
    got = [0] * len(room)
    open_ = [k for k in range(len(room)) if room[k] > 0 and weights[k] > 0]
    left = min(budget, sum(room[k] for k in open_))
    while left > 0 and open_:
        total = sum(weights[k] for k in open_)
        full = [k for k in open_ if room[k] - got[k] <= left * weights[k] / total]
        if full:
            for k in full:
                left -= room[k] - got[k]
                got[k] = room[k]
            open_ = [k for k in open_ if k not in full]
            continue
        exact = {k: left * weights[k] / total for k in open_}
        for k in open_:
            got[k] += int(exact[k])
        rest = left - sum(int(v) for v in exact.values())
        for k in sorted(open_, key=lambda k: (int(exact[k]) - exact[k], k))[:rest]:
            got[k] += 1
        left = 0
    return got


def budgets(supply: dict[tuple, int], weights: dict[tuple, float], budget: int, epochs: int) -> dict[tuple, int]:
    """The budget of each leaf path; weights by path of any depth, 1 where not given."""

    def down(prefix: tuple, amount: int, leaves: dict[tuple, int]) -> dict[tuple, int]:
        if len(leaves) == 1 and prefix in leaves:
            return {prefix: amount}
        groups: dict[tuple, dict] = {}
        for path, n in sorted(leaves.items()):
            groups.setdefault(path[: len(prefix) + 1], {})[path] = n
        names = list(groups)
        shares = share_out(amount, [float(weights.get(c, 1)) for c in names], [epochs * sum(groups[c].values()) for c in names])
        out = {}
        for c, a in zip(names, shares, strict=True):
            out |= down(c, a, groups[c])
        return out

    return down((), budget, supply) if supply else {}


def _cuts(keyed: DataFrame, rest: dict[tuple, int], rows: dict[tuple, int], few: int) -> dict[tuple, int]:
    """For each leaf the greatest key up to which its tokens fit its rest (below its first key if none do).

    keyed: mix_path, mix_tokens, mix_key. The range in which the rest ends is cut into 256 by the next byte of the key
    until it holds few rows for every leaf: a round sums in partial aggregates and sends 256 rows a leaf to the driver
    at most, so the work of a task does not grow with a leaf or with one repeated key.
    """
    if not rest:
        return {}
    depth, head, before, left = 0, dict.fromkeys(rest, 0), dict.fromkeys(rest, 0), {p: rows[p] for p in rest}
    place = F.col("mix_key").bitwiseXOR(F.lit(-(1 << 63)))  # unsigned order

    def edge() -> DataFrame:
        if not depth:
            return keyed
        heads = keyed.sparkSession.createDataFrame([(list(p), h) for p, h in head.items()], "mix_path array<string>, mix_head long")
        return keyed.join(F.broadcast(heads), "mix_path").where(F.shiftrightunsigned(place, 64 - depth) == F.col("mix_head"))

    def runs(step) -> dict[tuple, list]:
        out: dict[tuple, list] = {p: [] for p in rest}
        for r in edge().groupBy("mix_path", step.alias("step")).agg(F.sum("mix_tokens").alias("n"), F.count("*").alias("rows")).collect():
            out[tuple(r.mix_path)].append((r.step, r.n, r.rows))
        return out

    while max(left.values()) > few and depth < 56:
        for p, found in runs(F.shiftrightunsigned(place, 56 - depth).bitwiseAND(F.lit(255))).items():
            for step, n, count in sorted(found):
                if before[p] + n > rest[p]:
                    head[p], left[p] = head[p] << 8 | step, count
                    break
                before[p] += n
        depth += 8
    cuts = {}
    for p, found in runs(F.col("mix_key")).items():
        found.sort()
        cuts[p] = found[0][0] - 1
        for at, n, _ in found:
            before[p] += n
            if before[p] > rest[p]:
                break
            cuts[p] = at
    return cuts


def mix(docs: DataFrame, levels: dict, weights: dict[tuple, float], share: float = 0.5, epochs: int = 4, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", range_rows: int = 256) -> DataFrame:
    """docs with the columns mix_path, mix_tokens and mix_epoch, one row for each time a document is taken.

    levels: name to SQL expression, from the root down; share: the token budget as a share of the supply.
    """
    spark = docs.sparkSession
    key = lambda e: F.xxhash64(F.col("mix_id"), e, F.lit(seed))
    path = F.array(*(F.coalesce(F.expr(e).cast("string"), F.lit("")) for e in levels.values()))
    tokens = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
    own = [F.col(f"`{n}`").alias(f"c{k}") for k, n in enumerate(docs.columns)]
    marked = docs.select(*own, F.col(id_col).alias("mix_id"), path.alias("mix_path"), tokens.alias("mix_tokens"))
    slim = saved(marked.select("mix_id", "mix_path", "mix_tokens"), "mix-tokens")
    leaves = slim.groupBy("mix_path").agg(F.sum("mix_tokens").alias("n"), F.count("*").alias("rows")).collect()  # one row a leaf
    supply = {tuple(r.mix_path): r.n for r in leaves}
    target = budgets(supply, weights, int(share * sum(supply.values())), epochs)
    plan = [(list(p), b // supply[p], b % supply[p]) for p, b in target.items() if supply[p]]
    plan_df = spark.createDataFrame(plan, "mix_path array<string>, whole long, rest long").where("rest > 0")
    keyed = slim.join(F.broadcast(plan_df), "mix_path").select("mix_path", "mix_tokens", key(F.col("whole")).alias("mix_key"))
    cuts = _cuts(keyed, {p: r for p, _, r in ((tuple(x), w, r) for x, w, r in plan) if r}, {tuple(r.mix_path): r.rows for r in leaves}, range_rows)
    rows = [(p, w, w + 1 if r else w, cuts[tuple(p)] if r else None) for p, w, r in plan]
    final = F.broadcast(spark.createDataFrame(rows, "mix_path array<string>, mix_whole long, mix_turns long, mix_cut long"))
    taken = marked.join(final, "mix_path").where("mix_turns > 0").withColumn("mix_epoch", F.explode(F.expr("sequence(0L, mix_turns - 1)")))
    return taken.where((F.col("mix_epoch") < F.col("mix_whole")) | (key(F.col("mix_whole")) <= F.col("mix_cut"))).select(
        *(F.col(f"c{k}").alias(n) for k, n in enumerate(docs.columns)), *(F.col(n).alias(n + "_" * (n in docs.columns)) for n in ("mix_path", "mix_tokens", "mix_epoch"))
    )


LEVELS = {"domain": "if(n_chars >= 4000, 'longform', 'shortform')", "language": "lang", "source": "source"}
# Production weights of the tree.
WEIGHTS = {("longform",): 2.0, ("shortform",): 1.0} | {(d, k): w for d in ("longform", "shortform") for k, w in (("en", 5.0), ("de", 2.0), ("fr", 2.0), ("es", 1.0))}
