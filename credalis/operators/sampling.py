"""Seeded samples and design tables. Nothing depends on partitioning or row order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credalis.functions.seeded import hash_uniform, key_hash, pick, uniform
from credalis.functions.text import is_person_name, normalise_answer
from credalis.operators.prefix import attach, hash_rank, key_sizes, running_sums
from credalis.operators.ranking import top_k
from credalis.operators.selection import take_first
from credalis.session import checkpointed

LETTERS = "ABCDEFGHIJKLMNOP"
"""Option letters (fixed values)."""


def stratified_sample(df: DataFrame, by: Sequence[str], unit: Sequence[str], n: int, seed: str = "sample") -> DataFrame:
    """``n`` rows per stratum, nested: a smaller ``n`` gives a subset.

    The rank limit is applied inside the map tasks before the shuffle, so a hot
    stratum sends at most ``n`` rows per task.
    """
    keyed = df.withColumn("_key", key_hash(seed, *unit))
    return top_k(keyed, by, [F.col("_key")], n).drop("_key")


def balanced_sample(df: DataFrame, post: str, unit: Sequence[str], seed: str = "balance") -> DataFrame:
    """All later rows and equally many earlier ones, by exact hash rank."""
    late = df.filter(F.col(post))
    size = late.agg(F.count(F.lit(1)).alias("_k"))
    early = df.filter(~F.col(post)).withColumn("_key", key_hash(seed, *unit))
    chosen = take_first(early, [], F.lit(0.0), "_key", checkpointed(size), "_k").filter("taken")
    return late.unionByName(chosen.select(*df.columns))


def spread_sample(df: DataFrame, order: str, n: int) -> DataFrame:
    """Rows at ``n`` evenly spaced positions ``floor(i N / n)`` of a unique numeric order."""
    base = df.withColumns({"_o": F.col(order).cast("double"), "_one": F.lit(1.0)})
    ranked = running_sums(base, [], ["_o"], ["_one"])
    size = df.agg(F.count(F.lit(1)).alias("_size"))
    j = ranked.join(F.broadcast(size), F.lit(True))
    pos, total = F.col("before__one").cast("long"), F.col("_size")
    want = F.least(F.lit(n), total)
    i = F.ceil(pos * want / total)
    return j.filter((F.floor(i * total / want) == pos) & (i < want)).select(*df.columns)


def heldout_labels(df: DataFrame, label: str, n: int, seed: str = "heldout") -> DataFrame:
    """Add ``out_of_scope``: whether the row's label is among ``n`` held-out labels."""
    labels = df.select(label).distinct()
    held = labels.orderBy(key_hash(seed, label), label).limit(n).withColumn("_out", F.lit(True))
    return df.join(held, label, "left").withColumn("out_of_scope", F.coalesce("_out", F.lit(False))).drop("_out")


def _skip(r: Column, taken: Column) -> Column:
    """The ``r``-th position (from 0) that is not among the taken ones."""
    return F.aggregate(F.array_sort(taken), r, lambda a, e: F.when(e <= a, a + 1).otherwise(a))


def pool_index(pool: DataFrame, by: str, answer: str, seed: str = "pool") -> DataFrame:
    """Distinct answers of each pool with positions 0.. in hash order and the pool size ``m``.

    Answers that normalise to the same text count once.
    """
    norm = normalise_answer(answer)
    one = pool.filter(norm != "").groupBy(by, norm.alias("norm")).agg(F.min(answer).alias("answer"))
    ranked = hash_rank(one.withColumn("_key", key_hash(seed, by, "norm")), [by], "_key")
    return attach(ranked, key_sizes(one, [by], "m"), [by]).select(by, "norm", "answer", (F.col("rank") - 1).alias("pos"), "m")


def sample_distractors(
    df: DataFrame, pool: DataFrame, by: str, unit: str, gold: str, aliases: str, k: int = 3, seed: str = "distractor"
) -> DataFrame:
    """``k`` distinct wrong answers from the row's pool; null when the pool is too small.

    The pool is indexed once. A row draws ``k`` positions without replacement among
    those its gold and aliases do not occupy, so only ``k`` pool rows per question
    are joined, never the question's whole pool.
    """
    index = pool_index(pool, by, "answer")
    own = df.select(by, unit, F.explode(F.array_distinct(F.transform(F.concat(F.array(gold), aliases), normalise_answer))).alias("norm"))
    banned = own.join(index.select(by, "norm", "pos"), [by, "norm"]).groupBy(unit).agg(F.collect_list("pos").alias("_taken"))
    sizes = index.select(by, "m").distinct()
    q = df.join(sizes, by, "left").join(banned, unit, "left").withColumn("_taken", F.coalesce("_taken", F.array().cast("array<bigint>")))
    free = F.col("m") - F.size("_taken")
    drawn = q.withColumn("_free", free).withColumn("_t0", F.col("_taken"))
    for i in range(k):
        r = F.floor((F.col("_free") - i) * uniform(seed, unit, F.lit(i))).cast("long")
        drawn = drawn.withColumn(f"_p{i}", _skip(r, F.col(f"_t{i}"))).withColumn(
            f"_t{i + 1}", F.concat(F.col(f"_t{i}"), F.array(f"_p{i}"))
        )
    picks = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"_p{i}").alias("pos")) for i in range(k)])
    long = drawn.filter(F.col("_free") >= k).select(by, unit, F.inline(picks))
    got = long.join(index.select(by, "pos", "answer"), [by, "pos"]).groupBy(unit).agg(
        F.array_sort(F.collect_list(F.struct("i", "answer"))).alias("_d")
    )
    out = df.join(got, unit, "left")
    return out.withColumn("distractors", F.transform("_d", lambda x: x["answer"])).drop("_d")


def shuffle_options(df: DataFrame, unit: Sequence[str], answers: str, gold_index: str, seed: str = "shuffle") -> DataFrame:
    """Seeded order of each row's answers, option letters and the letter of the gold answer."""
    order = F.array_sort(
        F.transform(answers, lambda a, i: F.named_struct(F.lit("h"), key_hash(seed, *unit, i), F.lit("i"), i, F.lit("a"), a))
    )
    letters = F.array(*[F.lit(c) for c in LETTERS])
    t = df.withColumn("_o", order)
    pos = F.array_position(F.transform("_o", lambda x: x["i"]), F.col(gold_index).cast("int"))
    return t.withColumns(
        {
            "shown": F.transform("_o", lambda x: x["a"]), "options": F.slice(letters, 1, F.size("_o")),
            "gold": F.when(pos > 0, F.element_at(letters, pos.cast("int"))),
        }
    ).drop("_o")


def option_subsets(df: DataFrame, unit: Sequence[str], label: str, counts: Sequence[int], seed: str = "options") -> DataFrame:
    """For each K: the gold label and K-1 hashed others, in seeded order.

    The label list is one small row; each question picks from it inside its own row,
    without a shuffle.
    """
    labels = df.agg(F.array_sort(F.collect_set(label)).alias("_labels"))
    t = df.join(F.broadcast(labels), F.lit(True)).withColumn("K", F.explode(F.array(*[F.lit(int(k)) for k in counts])))
    t = t.filter(F.col("K") <= F.size("_labels"))

    def by_hash(values: Column, tag: str) -> Column:
        pairs = F.transform(values, lambda x: F.named_struct(F.lit("h"), key_hash(f"{seed}|{tag}", *unit, "K", x), F.lit("x"), x))
        return F.transform(F.array_sort(pairs), lambda s: s["x"])

    others = F.slice(by_hash(F.filter("_labels", lambda x: x != F.col(label)), "pick"), 1, F.col("K") - 1)
    return t.withColumn("options", by_hash(F.concat(F.array(label), others), "order")).drop("_labels")


def common_template(df: DataFrame, relation: str, question: str, subject: str) -> DataFrame:
    """Most frequent question template per relation, the first in text order on ties."""
    tmpl = F.replace(F.col(question), F.col(subject).cast("string"), F.lit("{}"))
    n = df.filter(F.col(subject).cast("string") != "").groupBy(relation, tmpl.alias("template")).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("neg"), "template"))
    return n.groupBy(relation).agg(best.alias("_b")).select(relation, F.col("_b.template").alias("template"), (-F.col("_b.neg")).alias("n"))


def first_per_question(df: DataFrame, key: str, order: str) -> DataFrame:
    """First row per id: a minimum, combined before the shuffle."""
    cols = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*cols), order).alias("_r")).select(key, "_r.*")


def recombine_names(names: DataFrame, existing: DataFrame, n: int, seed: str = "recombine", fewer: bool = False) -> DataFrame:
    """``n`` new names: first word of one person, the rest of another.

    ``names`` and ``existing`` have ``name``. Candidates are hashed pairs of donor
    positions; those that exist, repeat, or keep the first name are dropped and the
    first ``n`` of the rest stay. More candidates are drawn until there are ``n``.
    When the donors' pairs are used up, ``fewer`` returns every new name there is,
    from all pairs; otherwise an error is raised.
    """
    tries = 6 * n
    while True:
        made = _recombined(names, existing, tries, seed).orderBy("j").limit(n)
        if made.count() == n:
            return made
        people = names.filter(is_person_name("name")).select("name").distinct().count()
        if tries > 20 * people * people:
            if fewer:
                return _recombined(names, existing, people * people, seed, every=True).orderBy("j").limit(n)
            raise ValueError(f"{people} donors do not give {n} new names")
        tries *= 4


def _recombined(names: DataFrame, existing: DataFrame, tries: int, seed: str, every: bool = False) -> DataFrame:
    """Fresh names from ``tries`` candidates, or from every pair, each with the number ``j`` of its first one."""
    donors = names.filter(is_person_name("name")).select("name").distinct()
    ranked = hash_rank(donors.withColumn("_key", key_hash(seed, "name")), [], "_key").select("name", (F.col("rank") - 1).alias("pos"))
    size = donors.agg(F.count(F.lit(1)).alias("m"))
    c = names.sparkSession.range(tries).select(F.col("id").alias("j")).join(F.broadcast(size), F.lit(True))
    if every:
        c = c.withColumns({"pa": F.expr("j div m"), "pb": F.col("j") % F.col("m")})
    else:
        c = c.withColumns({"pa": pick(F.col("m"), seed, F.lit("a"), "j").cast("long"), "pb": pick(F.col("m"), seed, F.lit("b"), "j").cast("long")})
    a = ranked.select(F.col("name").alias("first_of"), F.col("pos").alias("pa"))
    b = ranked.select(F.col("name").alias("last_of"), F.col("pos").alias("pb"))
    j = c.join(a, "pa").join(b, "pb")
    first, other = F.substring_index("first_of", " ", 1), F.substring_index("last_of", " ", 1)
    rest = F.regexp_replace("last_of", r"^\S+\s+", "")
    made = j.filter(first != other).select("j", F.concat_ws(" ", first, rest).alias("name"), "first_of", "last_of")
    fresh = made.join(existing.select("name").distinct(), "name", "left_anti")
    return fresh.groupBy("name").agg(F.min(F.struct("j", "first_of", "last_of")).alias("_f")).select("name", "_f.*")


def derangement(labels: DataFrame, label: str, seed: str = "derange") -> DataFrame:
    """Each label with the next one in hash order (cyclic), so none maps to itself."""
    ids = labels.select(label).distinct()
    n = ids.agg(F.count(F.lit(1)).alias("_n"))
    r = hash_rank(ids.withColumn("_key", key_hash(seed, label)), [], "_key").drop("_key")
    r = r.join(F.broadcast(n), F.lit(True))
    nxt = r.select(F.col(label).alias("swapped"), F.col("rank"))
    return r.select(label, (F.col("rank") % F.col("_n") + 1).alias("rank")).join(nxt, "rank").select(label, "swapped")


def evidence_cells(df: DataFrame, unit: str, titles: str, support: str, seed: str = "evidence") -> DataFrame:
    """Four cells per question: no paragraph, two others, one support and one other, both supports."""
    others = F.array_except(titles, support)
    shuffled = F.transform(
        F.array_sort(F.transform(others, lambda x: F.named_struct(F.lit("h"), key_hash(seed, unit, x), F.lit("x"), x))), lambda s: s["x"]
    )
    t = df.withColumn("_pad", F.slice(shuffled, 1, 2)).filter((F.size(support) == 2) & (F.size("_pad") == 2))
    one = F.element_at(support, pick(F.lit(2), seed, unit, F.lit("first")) + 1)
    empty = F.array().cast("array<string>")
    cells = F.array(
        F.struct(F.lit("closed").alias("cell"), empty.alias("paragraphs")), F.struct(F.lit("dose0").alias("cell"), F.col("_pad").alias("paragraphs")),
        F.struct(F.lit("dose1").alias("cell"), F.array(one, F.col("_pad")[0]).alias("paragraphs")),
        F.struct(F.lit("dose2").alias("cell"), F.col(support).alias("paragraphs")),
    )
    return t.select(unit, F.inline(cells))


def plan_cells(items: DataFrame, dims: dict[str, Sequence]) -> DataFrame:
    """Design table: every item under every combination of small dimensions, then replicates."""
    out = items
    for name, values in dims.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out


def union_rows(parts: dict[str, DataFrame], tag: str = "part") -> DataFrame:
    """Stack result sets under a tag; columns a part lacks are null."""
    out: DataFrame | None = None
    for name, df in parts.items():
        d = df.withColumn(tag, F.lit(name))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def next_prime(n: int) -> int:
    """Smallest prime at or above ``n``."""
    n = max(n, 2)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def filler_to_length(keys: DataFrame, key: str, target: str, filler: DataFrame, text: str, seed: str = "filler") -> DataFrame:
    """Texts in a seeded order per key until a character target is reached.

    Each key walks the filler pool by ``(a j + b) mod p`` with ``p`` prime: an order
    without repeats that needs no shuffled copy of the pool. A key needs at most
    ``target / shortest text`` steps, so only those rows are joined. A key the whole
    pool cannot fill is an error.
    """
    texts = filler.select(F.col(text).alias("text")).filter(F.length("text") > 0).distinct()
    ranked = hash_rank(texts.withColumn("_key", F.md5("text")), [], "_key").select("text", (F.col("rank") - 1).alias("pos"))
    stats = texts.agg(F.count(F.lit(1)).alias("m"), F.min(F.length("text")).alias("short"), F.sum(F.length("text")).alias("all")).first()
    m, p = stats["m"], next_prime(stats["m"])
    h = key_hash(seed, key)
    a = F.floor(hash_uniform(h) * (p - 1)).cast("long") + 1
    b = F.floor(hash_uniform(F.reverse(h)) * p).cast("long")
    steps = F.least(F.lit(p), F.ceil(F.col(target) / F.lit(stats["short"])) + (p - m)).cast("int")
    lacking = F.raise_error(F.lit("not enough filler text"))
    steps = F.when(F.col(target) > stats["all"], lacking.cast("int")).otherwise(steps)
    walk = keys.filter(F.col(target) > 0).select(key, target, a.alias("_a"), b.alias("_b"), F.explode(F.sequence(F.lit(0), steps - 1)).alias("j"))
    walk = walk.withColumn("pos", (F.col("_a") * F.col("j") + F.col("_b")) % p)
    got = walk.join(ranked, "pos")
    w = Window.partitionBy(key).orderBy("j").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length("text")).over(w), F.lit(0))
    return got.withColumn("_before", before).filter(F.col("_before") < F.col(target)).select(key, "j", "text", target)


def verification_pairs(df: DataFrame, unit: str, options: str, gold: str) -> DataFrame:
    """Two rows per question: the gold answer and the first other option, with a truth flag."""
    wrong = F.filter(options, lambda o: o != F.col(gold))[0]
    rows = F.array(
        F.struct(F.lit(True).alias("truth"), F.col(gold).alias("proposed")), F.struct(F.lit(False).alias("truth"), wrong.alias("proposed"))
    )
    return df.select(unit, F.inline(rows)).withColumn(
        "verify_unit", F.concat_ws(":", F.lit("verify"), F.col(unit), F.when(F.col("truth"), "true").otherwise("false"))
    )


def ambiguous_candidates(df: DataFrame, unit: str, readings: str, fallback: str = "cannot tell") -> DataFrame:
    """Questions with 2 to 4 distinct first answers, or exactly one (controls).

    ``readings`` is an array of answer arrays; answers must differ as written and
    after normalisation. A fallback option is appended.
    """
    first = F.array_distinct(F.transform(readings, lambda r: F.try_element_at(r, F.lit(1))))
    t = df.withColumn("_a", F.filter(first, lambda x: x.isNotNull()))
    distinct = F.size(F.array_distinct(F.transform("_a", normalise_answer))) == F.size("_a")
    n = F.size("_a")
    kept = t.filter(distinct & (n <= 4) & (n >= 1))
    return kept.withColumns(
        {"kind": F.when(n >= 2, "ambiguous").otherwise("single"), "options": F.concat("_a", F.array(F.lit(fallback)))}
    ).drop("_a")


def condition_variants(df: DataFrame, unit: str, conditions: Sequence[str], prefix: str = "cutoff") -> DataFrame:
    """One row per condition of each question, keyed ``<prefix>:<condition>:<unit>``."""
    t = df.withColumn("cond", F.explode(F.array(*[F.lit(c) for c in conditions])))
    return t.withColumn("variant_unit", F.concat_ws(":", F.lit(prefix), F.col("cond"), F.col(unit)))
