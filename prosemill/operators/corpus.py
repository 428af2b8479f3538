"""The corpus pipeline's relational operators, C1-C26."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ENGLISH, corpus_tokens, let

# Logins of bots; grammar of attribution lines; sentinels.
BOT = r"(?i)\[bot\]\z|-bot\z|^dependabot|^renovate|^github-actions|^copilot\z|^pull\z|^truecharts-admin\z"
FOOTER = r"(?i)^\s*[^A-Za-z0-9_]{0,4}\s*(?:co-?authored[- ]by|generated (?:with|by)|created (?:with|by)|assisted by|authored by)\b"
SENTINEL = r"<!--\s*([A-Z][A-Z0-9]*(?:_[A-Z0-9]+){1,})\s*-->"

# Of k-means: centres that are broadcast have at most so many times max_cells numbers (256 MB by default), and counts are summed in parts of so many.
MODEL, PART = 16, 1 << 17


def without_bots(rows: DataFrame, login: str) -> DataFrame:
    return rows.where(~F.coalesce(F.col(login).rlike(BOT), F.lit(False)))


def split_footer(body: Column, most: int = 8) -> Column:
    """struct<text, footer>: the attribution block at the end and sentinels from anywhere, and the rest.

    The block starts at the topmost attribution line that only blank lines and other such lines part from the lowest
    one among the last `most` lines, and runs to the end.
    """
    sentinels = F.regexp_extract_all(body, F.lit(SENTINEL), F.lit(0))
    lines = F.split(F.regexp_replace(body, SENTINEL, " "), "\n", -1)
    n = F.size(lines)
    blank = lambda x: ~x.rlike(r"\S")
    signs = lambda x: x.rlike(FOOTER) | x.rlike(r"^\s*🤖")
    tail = F.sequence(n, F.greatest(n - most + 1, F.lit(1)))  # line numbers from the last one upwards

    def step(a: Column, i: Column) -> Column:
        x = F.element_at(lines, i)
        return F.when(a["over"] | blank(x), a).when(signs(x), F.struct(i.alias("cut"), F.lit(False).alias("over"))).otherwise(F.struct(a["cut"].alias("cut"), (a["cut"] <= n).alias("over")))

    cut = F.aggregate(tail, F.struct((n + 1).alias("cut"), F.lit(False).alias("over")), step, lambda a: a["cut"])
    own = F.array_join(F.slice(lines, cut, n), "\n")
    return F.struct(F.array_join(F.slice(lines, 1, cut - 1), "\n").alias("text"), F.regexp_replace(F.array_join(F.concat(sentinels, F.array(own)), "\n"), r"^\s+|\s+\z", "").alias("footer"))


def signed(footer: Column, markers: list[dict]) -> Column:
    """Whether a confirmed marker stands in the footer. markers: product and pattern."""
    return F.coalesce(footer.rlike("(?i)" + "|".join(m["pattern"] for m in markers)), F.lit(False)) if markers else F.lit(False)


def product_counts(footers: DataFrame, markers: list[dict], *by: str) -> DataFrame:
    """Documents by product; a document may count for several."""
    each = F.filter(F.array(*(F.when(F.col("footer").rlike("(?i)" + m["pattern"]), F.lit(m["product"])) for m in markers)), lambda x: x.isNotNull())
    return footers.select(*by, F.explode(each).alias("product")).groupBy(*by, "product").agg(F.count("*").alias("n"))


def tool_word(word: Column, names: list[str]) -> Column:
    """Whether a word holds one of the names between other characters than letters."""
    return word.rlike("(?i)(?:^|[^a-z])(?:" + "|".join(n.lower() for n in names) + r")(?:[^a-z]|\z)") if names else F.lit(False)


def unknown_footers(footers: DataFrame, known: str, least: int = 3, least_authors: int = 2) -> DataFrame:
    """Attribution lines that no known pattern matches, by normalised key; footers(author, footer)."""
    line = footers.select("author", F.explode(F.split("footer", "\n")).alias("line")).select("author", F.trim("line").alias("line"))
    sentinel = F.regexp_extract("line", SENTINEL, 1)
    line = line.where((F.col("line").rlike(FOOTER) | (sentinel != "") | F.col("line").rlike("^(?:🤖|👾)")) & ~F.col("line").rlike("(?i)" + known))
    key = F.lower("line")
    for pattern, to in ((r"\(https?:[^)]*\)", ""), ("<[^>]*>", ""), (r"[`*_\[\]]", ""), (r"\s+", " ")):
        key = F.regexp_replace(key, pattern, to)
    line = line.withColumn("key", F.when(sentinel != "", F.lower(sentinel)).otherwise(F.left(F.trim(key), F.lit(70)))).where("key <> ''")
    out = line.groupBy("key").agg(F.count("*").alias("seen"), F.countDistinct("author").alias("authors"), F.min(F.left("line", F.lit(120))).alias("example"))
    return out.where((F.col("seen") >= least) & (F.col("authors") >= least_authors))


def usable(docs: DataFrame, least: int = 25, english: float = 0.12) -> DataFrame:
    """Docs with tokens, long enough and English enough."""
    t = docs.withColumn("tokens", corpus_tokens(F.col("text")))
    return t.where((F.size("tokens") >= least) & (F.size(F.filter("tokens", lambda w: w.isin(ENGLISH))) >= english * F.size("tokens")))


def word_counts(tokens: Column) -> Column:
    """array<struct<word, tf>> of an array of words: sorted, and cut where the word changes."""

    def counted(s: Column) -> Column:
        begins = F.filter(F.transform(s, lambda w, i: F.when((i == 0) | ~F.get(s, i - 1).eqNullSafe(w), i)), lambda i: i.isNotNull())
        return let(begins, lambda b: F.transform(b, lambda i, k: F.struct(F.get(s, i).alias("word"), (F.coalesce(F.get(b, k + 1), F.size(s)) - i).cast("long").alias("tf"))))

    return let(F.sort_array(tokens), counted)  # array_sort compares by an interpreted function


def bag(tokens: DataFrame, *keys: str) -> DataFrame:
    """(keys, word, tf) from rows with tokens. Each row is a document of its own and counted inside itself: no shuffle."""
    return tokens.select(*keys, F.inline(word_counts(F.col("tokens"))))


def vocabulary(bags: DataFrame, min_df: int, *within: str) -> DataFrame:
    """Words that enough documents hold (a bag has one row per document and word)."""
    return bags.groupBy(*within, "word").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)


def row_vocabulary(rows: DataFrame, min_df: int) -> DataFrame:
    """vocabulary() of rows with a bag each, counted in each batch of them before words are shuffled."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def counted(batches):
        for batch in batches:
            got = pc.value_counts(batch.column(0).flatten())
            yield pa.RecordBatch.from_arrays([got.field(0), got.field(1)], ["word", "n"])

    return rows.select(F.col("bag.word").alias("word")).mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("df")).where(F.col("df") >= min_df)


def known_documents(bags: DataFrame, words: DataFrame, least: int = 5, *within: str) -> DataFrame:
    """Bags cut to the vocabulary, without documents that keep fewer than `least` words."""
    cut = bags.join(words.select(*within, "word"), [*within, "word"]).where("doc_id is not null")
    return cut.withColumn("k_", F.count("*").over(Window.partitionBy("doc_id"))).where(F.col("k_") >= least).drop("k_")


def known_counts(bags: DataFrame, words: DataFrame, least: int = 5) -> DataFrame:
    """(doc_id, known, tokens) of known_documents(), from sums of each part of the bags: no posting is shuffled for it."""
    cut = bags.join(words.select("word"), "word").where("doc_id is not null")
    return cut.groupBy("doc_id").agg(F.count("*").alias("known"), F.sum("tf").alias("tokens")).where(F.col("known") >= least)


def lift_rank(bags: DataFrame, group: str, prior: float = 25.0, sizes: DataFrame | None = None) -> DataFrame:
    """Document counts of words by group, lift (in / size) / ((all - in + prior) / others), and rank.

    sizes: group and size, the documents of each group that have a bag; counted from the bags if not given. With it the
    bags are read once.
    """
    docs = bags.select("doc_id", group).distinct().groupBy(group).agg(F.count("*").alias("size")) if sizes is None else sizes
    return lift_of(bags.groupBy(group, "word").agg(F.count("*").alias("inside")), docs, group, prior)


def lift_of(inside: DataFrame, docs: DataFrame, group: str, prior: float = 25.0) -> DataFrame:
    """lift_rank() from the counts (group, word, inside) and the sizes (group, size)."""
    total = docs.agg(F.sum("size").alias("n"))
    # a word has a row a group here
    j = inside.withColumn("every", F.sum("inside").over(Window.partitionBy("word"))).join(docs, group).join(F.broadcast(total))  # one row
    j = j.withColumn("lift", (F.col("inside") / F.col("size")) / ((F.col("every") - F.col("inside") + prior) / F.greatest(F.col("n") - F.col("size"), F.lit(1))))
    return j.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("lift"), "word"))).select(group, "word", "inside", "every", "lift", "rank")


def group_series(rows: DataFrame, group: str, week: str, flag: str) -> DataFrame:
    """C17: size, flagged share, shares of the group in the first and last four weeks, and whether it arrived."""
    weeks = rows.select(week).distinct().withColumn("i", F.row_number().over(Window.orderBy(week))).withColumn("j", F.max("i").over(Window.partitionBy()))
    j = rows.join(F.broadcast(weeks), week)  # one row a week
    every = j.agg(F.sum((F.col("i") <= 4).cast("long")).alias("first_all"), F.sum((F.col("i") > F.col("j") - 4).cast("long")).alias("last_all"))
    by = j.groupBy(group).agg(F.count("*").alias("size"), F.sum(F.col(flag).cast("long")).alias("signed"), F.sum((F.col("i") <= 4).cast("long")).alias("first"), F.sum((F.col("i") > F.col("j") - 4).cast("long")).alias("last"))
    out = by.join(every).withColumn("start_share", F.col("first") / F.col("first_all")).withColumn("end_share", F.col("last") / F.col("last_all"))
    return out.select(group, "size", "signed", "start_share", "end_share", ((F.col("start_share") < 0.02) & (F.col("end_share") >= 0.20)).alias("arrived"))


def weekly(rows: DataFrame, ts: str, *keys: str) -> DataFrame:
    """Counts by Monday week."""
    return rows.groupBy(F.date_trunc("week", ts).cast("date").alias("week"), *keys).agg(F.count("*").alias("n"))


def missing_days(days: DataFrame, first: str, last: str, most: int) -> DataFrame:
    """C11: days of the calendar without data, oldest first."""
    calendar = days.sparkSession.sql(f"select explode(sequence(date'{first}', date'{last}')) as day")
    return calendar.join(days.select("day").distinct(), "day", "left_anti").orderBy("day").limit(most)


def churn(snapshots: DataFrame) -> DataFrame:
    """The churn that C24 and C25 judge: share of each snapshot's words that its predecessor lacks; snapshots(generated, word)."""
    order = snapshots.select("generated").distinct().withColumn("before", F.lag("generated").over(Window.orderBy("generated")))
    new = snapshots.join(order, "generated").where("before is not null")
    old = snapshots.select(F.col("generated").alias("before"), "word", F.lit(1).alias("there"))
    return new.join(old, ["before", "word"], "left").groupBy("generated").agg(F.count("*").alias("words"), F.count(F.when(F.col("there").isNull(), 1)).alias("fresh")).withColumn("churn", F.col("fresh") / F.col("words"))


def pooled(snapshots: DataFrame, ceiling: float = 0.40, least: int = 2) -> DataFrame:
    """Words of the newest run of comparable snapshots that at least `least` of them hold; (word, n, place).

    snapshots(generated, word, rank). The run ends at the first snapshot of whose words more than `ceiling` are not in
    the one after it. A word has the rank of its newest snapshot; place is its number in that order.
    """
    order = snapshots.select("generated").distinct().withColumn("age", F.row_number().over(Window.orderBy(F.desc("generated"))))
    aged = snapshots.join(F.broadcast(order), "generated").select("age", "word", "rank")  # one row a snapshot
    newer = aged.select((F.col("age") + 1).alias("age"), "word", F.lit(1).alias("there"))
    moved = aged.where("age > 1").join(newer, ["age", "word"], "left").groupBy("age").agg((F.count(F.when(F.col("there").isNull(), 1)) / F.count("*")).alias("moved"))
    last = moved.where(F.col("moved") > ceiling).agg(F.coalesce(F.min("age") - 1, F.lit(1 << 30)).alias("last"))
    run = aged.join(F.broadcast(last)).where("age <= last")
    held = run.agg(F.least(F.lit(least), F.max("age")).alias("needed"))
    words = run.groupBy("word").agg(F.count("*").alias("n"), F.min(F.struct("age", "rank")).alias("at"))
    words = words.join(F.broadcast(held)).where("n >= needed")
    return words.select("word", "n", F.row_number().over(Window.orderBy("at.rank", "at.age", "word")).alias("place"))  # a word list


def churn_gate(current: DataFrame, pooled_words: DataFrame, floor: float = 0.10, ceiling: float = 0.40, bootstrap: bool = False) -> DataFrame:
    """One row: words, fresh, churn and outcome (write, same below the floor, refused above the ceiling)."""
    j = pooled_words.select("word").join(current.select("word", F.lit(1).alias("there")).distinct(), "word", "left")
    out = j.agg(F.count("*").alias("words"), F.count(F.when(F.col("there").isNull(), 1)).alias("fresh")).join(F.broadcast(current.agg(F.count("*").alias("had"))))
    churn_ = F.when(F.col("had") == 0, 1.0).otherwise(F.try_divide("fresh", "words"))
    free = (F.col("had") == 0) | F.lit(bootstrap)
    return out.select("words", "fresh", churn_.alias("churn"), F.when(~free & (churn_ > ceiling), "refused").when(~free & (churn_ < floor), "same").otherwise("write").alias("outcome"))


def per_million(rows: DataFrame, week: str, word: str, n: str, *within: str) -> DataFrame:
    """C20: counts of words by week with their rate per million of the week's words."""
    total = rows.groupBy(*within, week).agg(F.sum(n).alias("total"))
    return rows.join(total, [*within, week]).withColumn("per_million", F.col(n) / F.col("total") * 1e6)


def day_archive(docs: DataFrame, *keep: str, min_df: int = 2, least: int = 5) -> DataFrame:
    """Postings (day, doc_id, keep, word, tf) of documents with enough words of their day's vocabulary.

    docs: day, doc_id, tokens.
    """
    return day_postings(bag(docs, "day", "doc_id", *keep), min_df, least)


def day_postings(bags: DataFrame, min_df: int = 2, least: int = 5) -> DataFrame:
    """Bags (day, doc_id, word, tf, ...) cut to their day's vocabulary, without documents that keep fewer than `least` words.

    The long form stands in for day files; sources.archive keeps it by day. bags are read twice: give a written table.
    """
    cut = bags.join(vocabulary(bags, min_df, "day").select("day", "word"), ["day", "word"])
    return cut.withColumn("k_", F.count("*").over(Window.partitionBy("day", "doc_id"))).where(F.col("k_") >= least).drop("k_")


def day_bags(rows: DataFrame, least: int = 5) -> DataFrame:
    """(day, doc_id, bag, ...) with bags cut to words of two documents of their day, without documents that keep fewer than `least` words.

    What day_postings() gives at min_df = 2, with postings kept in their documents: a word is cut where one document
    alone holds it on its day, so the cut words find their document by its id, and no other posting is shuffled by
    itself. Rows without a day or an id are left out. rows are read twice: give a written table.
    """
    rows = rows.where("day is not null and doc_id is not null")
    held = rows.select("day", "doc_id", F.inline("bag")).groupBy("day", "word").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"))
    alone = held.where("n = 1").groupBy("day", "doc_id").agg(F.collect_list("word").alias("alone"))  # words of one document

    def kept(bag: Column, alone: Column) -> Column:
        # a mark sorts before the posting of its word
        marks = F.transform(alone, lambda w: F.struct(w.alias("word"), F.lit(-1).cast("long").alias("tf")))
        marked = lambda s: F.filter(s, lambda x, i: (x["tf"] >= 0) & ~F.coalesce(F.get(s, i - 1)["word"] == x["word"], F.lit(False)))
        return F.when(alone.isNull(), bag).otherwise(let(F.sort_array(F.concat(bag, marks)), marked))

    cut = rows.join(alone.hint("shuffle_hash"), ["day", "doc_id"], "left").withColumn("bag", kept(F.col("bag"), F.col("alone"))).drop("alone")
    return cut.withColumn("k_", F.sum(F.size("bag")).over(Window.partitionBy("day", "doc_id"))).where(F.col("k_") >= least).drop("k_")


def window_sample(events: DataFrame, windows: DataFrame) -> DataFrame:
    """The events (day, ts, ...) that fall into a window of their day; windows: day, window, start_second, seconds."""
    at = F.unix_timestamp("ts") - F.unix_timestamp(F.col("day").cast("timestamp"))
    return events.join(windows, "day").where(at.between(F.col("start_second"), F.col("start_second") + F.col("seconds") - 1))


def tracked(ranked: DataFrame, group: str, top: int) -> DataFrame:
    """The union of the groups' top words, with the groups that list each."""
    return ranked.where(F.col("rank") <= top).groupBy("word").agg(F.count("*").alias("groups"), F.min("rank").alias("best"))


def generator_states(seed: int) -> tuple[list[int], int]:
    """The states of the reference's generator, which multiplies in doubles, up to the first that comes again, and the place of its first coming.

    The generator runs into a cycle after some thousand steps, so any state is a look-up and no document is walked past.
    """
    states, places = [], {}
    while seed not in places:
        places[seed] = len(states)
        states.append(seed)
        seed = int(float(seed) * 1103515245.0 + 12345.0) & 0xFFFFFFFF
    return states, places[seed]


def drawn(ids: DataFrame, seed: int, save) -> DataFrame:
    """(doc_id, u): the generator's number in [0, 1) for each document, in the order of their ids.

    Ranges of ids are numbered from the sizes of those before them: a row a range reaches the driver.
    """
    import numpy as np
    import pyarrow as pa

    spark = ids.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = save(ids.repartitionByRange(n, "doc_id").withColumn("range", F.spark_partition_id()))
    sizes = sorted((r.range, r.n) for r in ranges.groupBy("range").agg(F.count("*").alias("n")).collect())
    before, at = [], 0
    for place, size in sizes:
        before.append((place, at))
        at += size
    starts = F.broadcast(spark.createDataFrame(before, "range int, start long"))  # a row a range
    numbered = ranges.join(starts, "range").select("doc_id", (F.col("start") + F.row_number().over(Window.partitionBy("range").orderBy("doc_id"))).alias("i"))
    states, cycle = generator_states(seed)

    def look_up(batches):
        values = np.array(states, np.float64) / 4294967296.0
        for batch in batches:
            i = batch.column(1).to_numpy()
            i = np.where(i < len(values), i, cycle + (i - cycle) % (len(values) - cycle))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values[i])], ["doc_id", "u"])

    return numbered.mapInArrow(look_up, f"doc_id {ids.schema['doc_id'].dataType.simpleString()}, u double")


def slices(ids: DataFrame, k: int, seed: int, save) -> DataFrame:
    """The reference's starting clusters: documents in the order of their ids, dealt by its generator; (doc_id, cluster)."""
    return drawn(ids, seed, save).select("doc_id", F.floor(F.col("u") * k).cast("int").alias("cluster"))


def kmeans(bags: DataFrame, k: int = 10, iterations: int = 25, seed: int = 12345, save=None, max_cells: int = 2_000_000) -> DataFrame:
    """C14: multinomial k-means; (doc_id, cluster). Ties go to the lowest cluster, empty clusters keep their centre.

    Documents start in the reference's slices; an empty slice has the centre of the first document. Rounds end when
    no document moves. Centres of at most MODEL times max_cells numbers are broadcast, and a round is one pass over packed
    documents; larger ones are joined by word. `save` (checkpoint() by default) cuts the lineage.
    """
    return kmeans_of(bags, [k], iterations, seed, save, max_cells).select("doc_id", F.col(f"k{k}").alias("cluster"))


def kmeans_of(bags: DataFrame, ks: list[int], iterations: int = 25, seed: int = 12345, save=None, max_cells: int = 2_000_000) -> DataFrame:
    """The fits of several k at once; doc_id and a column k<k> of clusters for each. A round is one pass for as many of them as have centres of MODEL times max_cells numbers together."""
    save = save or (lambda df: df.checkpoint())
    words = save(bags.select("word").distinct())
    if (v := words.count()) * max(ks) <= MODEL * max_cells:
        numbered = words.withColumn("i", (F.row_number().over(Window.orderBy("word")) - 1).cast("int"))  # at most MODEL * max_cells words
        pairs = F.sort_array(F.collect_list(F.struct("i", F.col("tf").cast("long").alias("tf"))))
        packed = save(bags.join(numbered, "word").groupBy("doc_id").agg(pairs.alias("p")).select("doc_id", F.col("p.i").alias("i"), F.col("p.tf").alias("tf")))
        return _PackedFits(packed, v, v, ks, iterations, seed, save, max_cells).clusters()
    fits = [_joined_kmeans(bags, words, k, iterations, seed, save).withColumnRenamed("cluster", f"k{k}") for k in ks]
    return reduce(lambda a, b: a.join(b, "doc_id"), fits)


def kmeans_rows(rows: DataFrame, words: DataFrame, ks: list[int], iterations: int = 25, seed: int = 12345, save=None, max_cells: int = 2_000_000, least: int = 5, inside: int | None = None):
    """kmeans_of() the known_documents() of rows with a bag each (doc_id, bag) and a vocabulary; no posting is shuffled by itself.

    With `inside`, one of the ks, also (cluster, word, inside): how many postings the clusters of that fit have of a word.
    """
    import pyarrow.compute as pc

    save = save or (lambda df: df.checkpoint())
    if words.count() * max(ks) > MODEL * max_cells:
        known = save(known_documents(rows.select("doc_id", F.inline("bag")), words, least).select("doc_id", "word", "tf"))
        fits = save(kmeans_of(known, ks, iterations, seed, save, max_cells))
        return (fits, known.join(fits, "doc_id").groupBy(F.col(f"k{inside}").alias("cluster"), "word").agg(F.count("*").alias("inside"))) if inside else fits
    listed = words.select("word").distinct().toArrow().column("word").combine_chunks()  # at most MODEL * max_cells words
    listed = listed.take(pc.sort_indices(listed))
    fits = _PackedFits(_packed_rows(rows, listed, least, save), len(listed), None, ks, iterations, seed, save, max_cells)
    return (fits.clusters(), fits.inside(inside, listed)) if inside else fits.clusters()


def _packed_rows(rows: DataFrame, listed, least: int, save) -> DataFrame:
    """(doc_id, i, tf) of documents with `least` postings of the listed words, i being places in the list. Rows of one id are one document."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    held = rows.sparkSession.sparkContext.broadcast(listed)

    def numbered(batches):
        for batch in batches:
            ids, word, tf = batch.columns
            at = pc.index_in(word.flatten(), value_set=held.value)
            known = at.is_valid()
            bounds = word.offsets.to_numpy()
            before = np.concatenate([[0], np.cumsum(known.to_numpy(zero_copy_only=False))])[bounds - bounds[0]]
            cut = pa.array(before.astype(np.int32))
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(cut, at.drop_null()), pa.ListArray.from_arrays(cut, tf.flatten().filter(known)), pa.array(np.diff(before))], ["doc_id", "i", "tf", "n"])

    bags = rows.where("doc_id is not null and size(bag) > 0").select("doc_id", F.col("bag.word").alias("word"), F.col("bag.tf").cast("array<long>").alias("tf"))
    packed = save(bags.mapInArrow(numbered, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, i array<int>, tf array<long>, n long"))
    known = save(packed.groupBy("doc_id").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).where(F.col("n") >= least))
    if not known.where("rows > 1").isEmpty():
        packed = packed.groupBy("doc_id").agg(F.flatten(F.collect_list("i")).alias("i"), F.flatten(F.collect_list("tf")).alias("tf"))
    return packed.join(known.select("doc_id"), "doc_id", "left_semi").select("doc_id", "i", "tf")


def _blocks(packed: DataFrame, most: int = 1 << 18) -> DataFrame:
    """Documents (doc_id, u, i, tf) of about `most` postings as one row, longest first: ids, numbers u, lengths n, and their postings.

    Postings stand by their place in the document: the first ones of all documents, then the second ones of those that
    have two, and so on. What a sum over each document's words takes is thus one addition of columns for each place.
    """
    import numpy as np
    import pyarrow as pa

    def block(ids, u, n, starts, word, times, chosen):
        n = n[chosen]
        first, live = _places(n)
        rank = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(rank)) - np.repeat(np.cumsum(n) - n, n)
        source, target = np.repeat(starts[chosen], n) + place, first[place] + rank
        i, tf = np.empty(len(rank), np.int32), np.empty(len(rank), np.int64)
        i[target], tf[target] = word[source], times[source]
        small = tf.astype(np.uint8)
        tf = small if (small == tf).all() else tf
        columns = [pa.array([x.tobytes()], pa.binary()) for x in (u[chosen], n.astype(np.int32), i, tf)]
        mine = ids.take(pa.array(chosen))
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(mine)], pa.int32()), mine), *columns], ["doc_id", "u", "n", "i", "tf"])

    def made(held):
        t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        ids, u, i, tf = t.columns
        bounds = i.offsets.to_numpy().astype(np.int64)
        n, starts = np.diff(bounds), bounds[:-1] - bounds[0]
        order = np.argsort(-n, kind="stable")
        group = np.cumsum(n[order]) // most
        for chosen in np.split(order, np.flatnonzero(np.diff(group)) + 1):
            yield block(ids, u.to_numpy(), n, starts, i.flatten().to_numpy(), tf.flatten().to_numpy(), chosen)

    def build(batches):
        held, size = [], 0
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                held.append(batch)
                size += len(batch.column(2).flatten())
                if size >= 16 * most:  # documents of about one length come together
                    yield from made(held)
                    held, size = [], 0
        if held:
            yield from made(held)

    t = packed.schema["doc_id"].dataType.simpleString()
    return packed.select("doc_id", "u", "i", "tf").mapInArrow(build, f"doc_id array<{t}>, u binary, n binary, i binary, tf binary")


def _places(n):
    """For documents of n postings, n not rising: where the postings of each place begin, and how many documents have one there."""
    import numpy as np

    live = np.searchsorted(-n, -np.arange(n[0] if len(n) else 0), "left")
    return np.cumsum(live) - live, live


def _scores(model, n, word, times, few: int = 32):
    """By document of a block the sums of its words' rows of the model, each as often as the word stands there, added up in the order of the words."""
    import numpy as np

    first, live = _places(n)
    sums, rows = np.zeros((len(n), model.shape[1])), np.empty((len(n), model.shape[1]))
    many = int(np.searchsorted(-live, -few, "right"))  # places that at least `few` documents have
    for at, m in zip(first[:many].tolist(), live[:many].tolist(), strict=True):
        got = np.take(model, word[at : at + m], axis=0, out=rows[:m], mode="clip")
        got *= times[at : at + m, None]
        sums[:m] += got
    for d in range(live[many] if many < len(live) else 0):  # the rest of few long documents, one by one
        for lo in range(many, n[d], 1000):
            at = first[lo : min(lo + 1000, n[d])] + d
            sums[d] = np.add.accumulate(np.vstack([sums[d : d + 1], model[word[at]] * times[at, None]]))[-1]
    return sums


class _PackedFits:
    """C14: the fits of several k over packed documents (doc_id, i, tf); i below width, v of which occur (None: those that are counted).

    The centres of a pass are broadcast, as words by clusters; a task adds up the counts of its documents, and tasks' counts
    meet in parts of PART numbers.
    """

    def __init__(self, packed, width, v, ks, iterations, seed, save, max_cells):
        import numpy as np

        self.spark, self.width, self.ks, self.most = packed.sparkSession, width, ks, MODEL * max_cells
        self.id_type = packed.schema["doc_id"].dataType.simpleString()
        self.blocks = save(_blocks(packed.join(drawn(packed.select("doc_id"), seed, save), "doc_id")))
        least = packed.agg(F.min("doc_id").alias("doc_id")).first().doc_id
        start = np.zeros((width, 1), np.int64)  # the first document: the centre of empty slices
        for row in packed.where(F.col("doc_id") == F.lit(least)).select("i", "tf").collect() if least is not None else []:
            np.add.at(start[:, 0], row.i, row.tf)
        centres = {k: start for k in ks}
        used, open_ = dict(centres), list(ks) if least is not None else []
        for group in self.together(open_):
            centres |= self.moved(centres, self.counted(None, group))
        v = int((centres[ks[0]].any(axis=1)).sum()) if v is None else v
        self.v = v
        for _ in range(iterations):
            if not open_:
                break
            used |= {k: centres[k] for k in open_}
            made = {}
            for group in self.together(open_):
                made |= self.moved(centres, self.counted({k: centres[k] for k in group}, group))
            # the same centres make the clusters that are there: no document would move again
            open_ = [k for k in open_ if (made[k] != centres[k]).any()]
            centres |= made
        self.used = used if iterations and least is not None else None

    def together(self, some):
        """The fits in groups whose centres have at most `most` numbers, each of which is one pass."""
        groups: list[list[int]] = []
        for k in some:
            if groups and (sum(groups[-1]) + k) * self.width <= self.most:
                groups[-1].append(k)
            else:
                groups.append([k])
        return groups

    @staticmethod
    def moved(centres, counts):
        """The counts as new centres; a cluster without documents keeps the centre that it has."""
        import numpy as np

        return {k: np.where(n.sum(axis=0, keepdims=True) > 0, n, centres[k]) for k, n in counts.items()}

    def model(self, centres, group):
        """The broadcast logarithms of the centres of a group's fits, words by clusters."""
        import numpy as np

        out = np.empty((self.width, sum(group)))
        at = 0
        for k in group:
            c = centres[k]
            out[:, at : at + k] = np.log((c + 0.01) / (c.sum(axis=0, keepdims=True) + 0.01 * self.v))
            at += k
        return self.spark.sparkContext.broadcast(out)

    def parts(self, held, group, once=False):
        """(part, n) of the numbers of postings (once) or occurrences by word and cluster, the clusters of a group's fits side by side."""
        import numpy as np
        import pyarrow as pa

        width, all_, size = self.width, sum(group), PART

        def run(batches):
            total = np.zeros(width * all_, np.int64)
            model = held and held.value
            for batch in batches:
                for u, n, word, times, _ in _unpacked(batch):
                    first, live = _places(n)
                    rank = np.arange(len(word)) - np.repeat(first, live)
                    cells = word.astype(np.int64) * all_
                    at = 0
                    for k, cluster in zip(group, _nearest(model, group, u, n, word, times), strict=True):
                        np.add.at(total, cells + (at + cluster)[rank], 1 if once else times)
                        at += k
            for part, at in enumerate(range(0, len(total), size)):
                if total[at : at + size].any():
                    yield sent(part, total[at : at + size])

        def added(batches):
            sums: dict = {}
            for batch in batches:
                for part, n in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    sums[part] = sums.get(part, 0) + _piece(part, n, width * all_, size)
            for part, n in sums.items():
                yield sent(part, n)

        def sent(part, n):
            # what is shuffled once a round has the bytes that its largest number needs
            n = n.astype(next((t for t in (np.uint8, np.uint16, np.uint32) if 0 <= n.min() and n.max() <= np.iinfo(t).max), np.int64))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n.tobytes()], pa.binary())], ["part", "n"])

        return self.blocks.mapInArrow(run, "part int, n binary").repartition("part").mapInArrow(added, "part int, n binary")

    def counted(self, centres, group):
        """By fit, the occurrences of words in the clusters that the centres make; None stands for the slices."""
        import numpy as np

        held = centres and self.model(centres, group)
        got = self.parts(held, group).toArrow()  # at most `most` numbers
        out = np.zeros(self.width * sum(group), np.int64)
        for part, n in zip(got.column("part").to_pylist(), got.column("n"), strict=True):
            piece = _piece(part, n, len(out), PART)
            out[part * PART : part * PART + len(piece)] = piece
        if held:
            held.destroy()
        ends = np.cumsum(group).tolist()
        return {k: out.reshape(self.width, -1)[:, end - k : end].copy() for k, end in zip(group, ends, strict=True)}

    def clusters(self) -> DataFrame:
        """doc_id and a column k<k> of clusters for each fit."""
        import numpy as np
        import pyarrow as pa

        ids = f"doc_id {self.id_type}"

        def of(group):
            held = self.used and self.model(self.used, group)

            def assign(batches):
                for batch in batches:
                    for u, n, word, times, ids in _unpacked(batch):
                        found = _nearest(held and held.value, group, u, n, word, times)
                        yield pa.RecordBatch.from_arrays([ids, *(pa.array(c.astype(np.int32)) for c in found)], ["doc_id", *(f"k{k}" for k in group)])

            return self.blocks.mapInArrow(assign, ", ".join([ids, *(f"k{k} int" for k in group)]))

        return reduce(lambda a, b: a.join(b, "doc_id"), [of(group) for group in self.together(self.ks)])

    def inside(self, k: int, listed) -> DataFrame:
        """(cluster, word, inside): the postings of each word in the clusters of one fit."""
        import numpy as np
        import pyarrow as pa

        words, size, cells = self.spark.sparkContext.broadcast(listed), PART, self.width * k

        def spread(batches):
            for batch in batches:
                for part, n in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    n = _piece(part, n, cells, size)
                    found = np.flatnonzero(n)
                    word, cluster = np.divmod(part * size + found, k)
                    yield pa.RecordBatch.from_arrays([pa.array(cluster.astype(np.int32)), words.value.take(pa.array(word)), pa.array(n[found])], ["cluster", "word", "inside"])

        held = self.used and self.model(self.used, [k])
        return self.parts(held, [k], once=True).mapInArrow(spread, "cluster int, word string, inside long")


def _piece(part, n, cells, size):
    """The numbers of a part of `size` of all cells, sent in as few bytes as they need."""
    import numpy as np

    n = n.as_buffer()
    width = n.size // min(size, cells - part * size)
    return np.frombuffer(n, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[width]).astype(np.int64)


def _unpacked(batch):
    """u, n, word, times and ids of each row of _blocks()."""
    import numpy as np

    for at in range(batch.num_rows):
        u, n, word, times = (batch.column(c)[at].as_buffer() for c in range(1, 5))
        word = np.frombuffer(word, np.int32)
        times = np.frombuffer(times, np.int64 if times.size == 8 * len(word) else np.uint8).astype(np.int64)
        yield np.frombuffer(u, np.float64), np.frombuffer(n, np.int32).astype(np.int64), word, times, batch.column(0)[at].values


def _nearest(model, group, u, n, word, times):
    """By fit, the clusters of a block's documents: the nearest centres, or the slices where there is no model."""
    import numpy as np

    if model is None:
        return [(u * k).astype(np.int64) for k in group]
    scores = _scores(model, n, word, times.astype(np.float64))
    ends = np.cumsum(group).tolist()
    return [scores[:, end - k : end].argmax(axis=1) for k, end in zip(group, ends, strict=True)]


def _joined_kmeans(bags: DataFrame, words: DataFrame, k: int, iterations: int, seed: int, save) -> DataFrame:
    spark = bags.sparkSession
    lengths = save(bags.groupBy("doc_id").agg(F.sum("tf").alias("n")))
    assign = save(slices(lengths.select("doc_id"), k, seed, save))
    v = words.count()
    grid = spark.range(k).select(F.col("id").cast("int").alias("cluster"))
    first = bags.join(lengths.agg(F.min("doc_id").alias("doc_id")), "doc_id").select("word", F.col("tf").alias("c"))
    before = grid.join(F.broadcast(first))  # k times the words of one document
    for _ in range(iterations):
        counts = bags.join(assign, "doc_id").groupBy("cluster", "word").agg(F.sum("tf").alias("c"))
        kept = before.join(assign.select("cluster").distinct(), "cluster", "left_anti")
        counts = save(counts.unionByName(kept.select("cluster", "word", "c")))
        before = counts
        floor = {r.cluster: float(r.f) for r in counts.groupBy("cluster").agg(F.log(F.lit(0.01) / (F.sum("c") + 0.01 * v)).alias("f")).collect()}  # k rows
        # what a word adds beyond the floor that an unseen word has in the cluster, one column a cluster
        added = F.log((F.col("c") + 0.01) / 0.01)
        extra = counts.groupBy("word").agg(*(F.coalesce(F.sum(F.when(F.col("cluster") == c, added)), F.lit(0.0)).alias(f"l{c}") for c in range(k)))
        scored = lengths.join(bags.join(extra, "word").groupBy("doc_id").agg(*(F.sum(F.col("tf") * F.col(f"l{c}")).alias(f"s{c}") for c in range(k))), "doc_id")
        best = F.array_max(F.array(*(F.struct((F.col("n") * F.lit(floor.get(c, 0.0)) + F.col(f"s{c}")).alias("s"), F.lit(-c).alias("neg")) for c in range(k))))
        new = save(scored.select("doc_id", (-best["neg"]).alias("cluster")))
        settled = new.join(assign.withColumnRenamed("cluster", "old"), "doc_id").where("cluster <> old").isEmpty()
        assign = new
        if settled:
            break
    return assign


def clusters_of(assign: DataFrame, rows: DataFrame, week: str = "week", flag: str = "signed") -> DataFrame:
    """Cluster, size, signed, share, stamped, start_share, end_share and arrived; rows(doc_id, week, signed)."""
    j = rows.join(assign, "doc_id").select("cluster", week, flag)
    series = group_series(j, "cluster", week, flag)
    total = series.agg(F.sum("size").alias("every"))
    return series.join(F.broadcast(total)).select("cluster", "size", "signed", (F.col("size") / F.col("every")).alias("share"), (F.col("signed") / F.col("size")).alias("stamped"), "start_share", "end_share", "arrived")


def sweep(bags: DataFrame, rows: DataFrame, ks: list[int], save, **options) -> DataFrame:
    """The cluster statistics of a fit for each k, all fitted together; (k, cluster, ...). judge_fits() decides among them."""
    return swept(save(kmeans_of(bags, ks, save=save, **options)), rows, ks)


def swept(fitted: DataFrame, rows: DataFrame, ks: list[int]) -> DataFrame:
    """The cluster statistics of fits (doc_id, k<k>); (k, cluster, ...)."""
    fits = (clusters_of(fitted.select("doc_id", F.col(f"k{k}").alias("cluster")), rows).withColumn("k", F.lit(k)) for k in ks)
    return reduce(DataFrame.unionByName, fits)


def judge_fits(fits: DataFrame) -> DataFrame:
    """By k: the cluster of the highest signed share, that of the highest recent share among those that arrived, the gap and whether they agree."""
    w = Window.partitionBy("k")
    ranked = fits.withColumn("place", F.row_number().over(w.orderBy(F.desc("stamped"), "cluster")))
    grew = F.max(F.when(F.col("arrived"), F.struct("end_share", (-F.col("cluster")).alias("neg"))))
    by = ranked.groupBy("k").agg(F.max(F.when(F.col("place") == 1, F.col("cluster"))).alias("signature"), F.max(F.when(F.col("place") == 1, F.col("stamped"))).alias("s1"), F.max(F.when(F.col("place") == 2, F.col("stamped"))).alias("s2"), grew.alias("g"), F.sum(F.col("arrived").cast("long")).alias("admitted"))
    by = by.withColumn("growth", -F.col("g.neg")).withColumn("gap", F.when(F.col("s2").isNull(), 1.0).otherwise(F.col("s1") - F.col("s2")))
    return by.select("k", "signature", "growth", "admitted", "gap", F.coalesce(F.col("growth") == F.col("signature"), F.lit(False)).alias("agree"))


def choose_fit(fits: DataFrame) -> DataFrame:
    """Of the fits whose two selectors agree, the one with the widest gap; no row if none agrees.

    fits: k, cluster, stamped, end_share, arrived.
    """
    return judge_fits(fits).where("agree").orderBy(F.desc("gap"), "k").limit(1).select("k", F.col("signature").alias("cluster"), "gap")


def latest_wins(history: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """History with the rows of new in place of its own of the same key."""
    return history.join(new.select(key).distinct(), key, "left_anti").unionByName(new)
