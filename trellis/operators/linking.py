"""Names to canonical names: aliases in brackets, and similar names, joined into components."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bracketed, main_name, normalize, similarity, strip
from ..runtime import stored
from .components import connected_components


def entity_names(triples: DataFrame) -> DataFrame:
    """The distinct heads and tails."""
    return triples.select(F.col("head").alias("name")).union(triples.select("tail")).distinct()


def alias_edges(names: DataFrame) -> DataFrame:
    """(src, dst): each normalized main name with each normalized alias in its brackets, and with itself."""
    rows = names.select(normalize(strip(main_name(F.col("name")))).alias("src"), bracketed(F.col("name")).alias("aliases")).filter("src <> ''")
    pairs = rows.select("src", F.explode("aliases").alias("raw")).select("src", normalize(F.col("raw")).alias("dst")).filter("dst <> ''")
    return pairs.union(rows.select("src", F.col("src").alias("dst"))).distinct()


def duplicate_edges(names: DataFrame) -> DataFrame:
    """(src, src) for each normalized name that several raw names have: these are registered as names, nothing more."""
    full = names.select(normalize(F.col("name")).alias("src")).filter("src <> ''")
    return full.groupBy("src").agg(F.count("*").alias("n")).filter("n > 1").select("src", F.col("src").alias("dst"))


def similar_edges(names: DataFrame, threshold: float = 90.0) -> DataFrame:
    """Pairs of distinct normalized names whose indel similarity is at least `threshold` (0-100]; all of them, candidates being verified exactly."""
    return candidates(names, threshold).filter(similarity("src", "dst") >= threshold).select("src", "dst")


def candidates(names: DataFrame, threshold: float) -> DataFrame:
    """(src, dst) that similar_edges verifies: pairs that met, each once, whose letters are alike enough.

    Names of total length T are similar if they differ in at most D = T * (1 - share) inserted or deleted characters, so in as many letters,
    counted with repeats. Pairs with a shorter name of up to LONGEST_SHORT characters meet by letters, longer ones by parts that stand whole."""
    share = threshold / 100.0
    base = names.select(normalize(F.col("name")).alias("name")).filter("name <> ''").distinct().withColumn("n", F.length("name"))
    base = stored(base, "names")
    pairs = _met_by_letters(base, share)
    if share > 0.67:
        longest = base.agg(F.max("n")).first()[0] or 0
        if longest > LONGEST_SHORT:
            pairs = pairs.unionByName(_met_by_parts(base, share).distinct())
    return pairs.filter(2 * _common_letters(F.col("src"), F.col("dst")) >= share * (F.length("src") + F.length("dst")) - 1e-9)


def _common_letters(a: Column, b: Column) -> Column:
    """How many letters two names have in common, each as often as both have it: no common subsequence is longer."""
    often = lambda name, c: F.length(name) - F.length(F.replace(name, c, F.lit("")))
    return F.aggregate(F.array_distinct(F.split(a, "(?!^)")), F.lit(0), lambda n, c: n + F.least(often(a, c), often(b, c)))


#: Pairs whose shorter name has up to so many characters meet by letters (below 67, where parts are too short to tell, all do).
LONGEST_SHORT = 64
#: Letters that are dealt to groups by how much they tell; others are dealt by a hash.
LETTERS = 200
#: Sets of groups by which a name is looked up for one band of lengths, at most.
WAYS = 100
#: Names of one key that one block has, about.
NAMES_A_BLOCK = 1_000


def _bands(share: float, longest: int) -> list[tuple[int, int, int, int]]:
    """(first, last, D, k) for bands of lengths of a pair's shorter name: D is the most that a pair of the band may differ in, and
    names are cut into D + k groups of letters, of which k at least are the same in both."""
    out, first = [], 1
    while first <= longest:
        last = min(longest, max(first, int(first * 1.25)))
        most = int((last + int(last * (2 - share) / share + 1e-9)) * (1 - share) + 1e-9)
        k = next((k for k in (3, 2) if comb(most + k, k) <= WAYS), 1)
        out.append((first, last, most, k))
        first = last + 1
    return out


def _met_by_letters(base: DataFrame, share: float) -> DataFrame:
    """Candidate pairs whose shorter name is short. Letters are dealt to D + k groups; an inserted or deleted character changes one group, so k groups
    have the same letters in both names. Names meet by k groups and what they have in them; a pair counts where its first k equal groups are the key's."""
    longest = LONGEST_SHORT if share > 0.67 else base.agg(F.max("n")).first()[0] or 0
    chars = base.select("name", F.explode(F.split("name", "(?!^)")).alias("c")).groupBy("name", "c").agg(F.count("*").alias("times"))
    # how much each letter tells: the entropy of how often names have it; those that tell most are dealt in turn, back and forth
    total = base.count()
    if not total:
        return base.select(F.col("name").alias("src"), F.col("name").alias("dst"))
    spread = chars.groupBy("c", "times").agg(F.count("*").alias("m"))
    have = spread.groupBy("c").agg(F.sum("m").alias("have"), F.sum(-F.col("m") / total * F.log2(F.col("m") / total)).alias("told"))
    rest = (total - F.col("have")) / total
    told = have.select("c", (F.col("told") - F.when(rest > 0, rest * F.log2(rest)).otherwise(0.0)).alias("told")).orderBy(F.desc("told"), "c").limit(LETTERS).collect()
    frames = []
    for first, last, most, k in _bands(share, longest):
        m = most + k
        sums, of = [0.0] * m, {}
        for r in told:
            g = min(range(m), key=lambda i: (sums[i], i))
            of[r["c"]], sums[g] = g, sums[g] + r["told"]
        table = F.create_map(*(F.lit(v) for kv in of.items() for v in kv)) if of else F.create_map().cast("map<string,int>")
        dealt = F.transform(F.split("name", "(?!^)"), _dealer(table, m))
        inside = base.filter((F.col("n") >= first) & (F.col("n") <= int(last * (2 - share) / share + 1e-9))).select("name", "n", dealt.alias("dealt"))
        groups = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda g: F.array_join(F.array_sort(F.transform(F.filter("dealt", lambda x: x["g"] == g), lambda x: x["c"])), ""))
        ways = F.array(*(F.array(*map(F.lit, w)) for w in combinations(range(m), k)))
        keyed = inside.select("name", "n", groups.alias("groups")).select("name", "n", "groups", F.explode(ways).alias("way"))
        key = F.xxhash64(F.lit(first), F.col("way"), F.transform("way", lambda i: F.col("groups")[i]))
        frames.append(keyed.select("name", "n", "groups", "way", key.alias("key"), F.lit(first).alias("first"), F.lit(last).alias("last"), F.lit(k).alias("k")))
    keyed = frames[0]
    for f in frames[1:]:
        keyed = keyed.unionByName(f)
    keyed = stored(keyed, "keys")
    met = in_blocks(keyed, "key", "name", NAMES_A_BLOCK, ["n", "groups", "way", "first", "last", "k"])
    short = F.least("a.n", "b.n")
    same = F.filter(F.sequence(F.lit(0), F.size("a.groups") - 1), lambda i: F.col("a.groups")[i] == F.col("b.groups")[i])
    met = met.filter((short >= F.col("a.first")) & (short <= F.col("a.last")) & (2 * short >= share * (F.col("a.n") + F.col("b.n")) - 1e-9))
    met = met.filter((F.col("a.first") == F.col("b.first")) & (F.slice(same, 1, F.col("a.k")) == F.col("a.way")) & (F.col("a.way") == F.col("b.way")))
    return met.select(F.least("a.name", "b.name").alias("src"), F.greatest("a.name", "b.name").alias("dst"))


def _dealer(table: Column, groups: int) -> Callable[[Column], Column]:
    """A letter with the number of its group."""
    return lambda c: F.struct(c.alias("c"), F.coalesce(F.element_at(table, c), F.pmod(F.hash(c), F.lit(groups))).alias("g"))


def in_blocks(rows: DataFrame, key: str, member: str, block: int, more: list[str]) -> DataFrame:
    """Pairs (a, b) of different members of one key, once each, as structs. A key's members are dealt into blocks of about `block`, and each block
    meets every other and itself under a key of its own, so that no key of the join has more than block x block pairs."""
    sizes = rows.groupBy(key).agg(F.count("*").alias("of")).filter("of > 1").select(key, F.ceil(F.col("of") / block).cast("int").alias("blocks"))
    shared = rows.join(sizes, key).select(key, F.struct(member, *more).alias("x"), "blocks", F.pmod(F.hash(member), F.col("blocks")).alias("own"))
    a = shared.select(key, F.col("x").alias("a"), F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"))
    b = shared.select(key, F.col("x").alias("b"), F.explode(F.sequence(F.lit(0), "own")).alias("i"), F.col("own").alias("j"))
    mine, other = F.col(f"a.{member}"), F.col(f"b.{member}")
    return a.join(b, [key, "i", "j"]).filter((F.col("i") < F.col("j")) & (mine != other) | (F.col("i") == F.col("j")) & (mine < other)).select(key, "a", "b")


def _met_by_parts(base: DataFrame, share: float) -> DataFrame:
    """Candidate pairs for a similarity over two thirds.

    Names of total length T differ in at most (1 - share) T inserted or deleted characters. The shorter name, of length l, is cut into one
    part more than that number for its longest partner. A character changes one part at most, so one part stands whole in the longer name,
    shifted by no more than the changes allow: names meet by (l, number of the part, its characters). At 90 parts have four characters or more.
    """
    whole = lambda x: F.floor(x + 1e-9).cast("int")  # noqa: E731 - products of decimal fractions fall just below whole numbers
    longest = lambda n: whole(n * ((2 - share) / share))
    parts = lambda n: whole((n + longest(n)) * (1 - share)) + 1
    begin = lambda n, i, of: F.floor(i * n / of).cast("int")
    short = base.filter(F.col("n") > LONGEST_SHORT).withColumn("of", parts(F.col("n"))).select("name", F.col("n").alias("l"), "of", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("i"))
    short = short.withColumns({"start": begin(F.col("l"), F.col("i"), F.col("of")), "stop": begin(F.col("l"), F.col("i") + 1, F.col("of"))})
    short = short.select("l", "i", F.expr("substring(name, start + 1, stop - start)").alias("part"), F.col("name").alias("shorter"))
    shortest = F.greatest(F.lit(LONGEST_SHORT + 1), F.ceil(F.col("n") * (share / (2 - share)) - 1e-9).cast("int"))
    long = base.filter(shortest <= F.col("n")).select("name", "n", F.explode(F.sequence(shortest, F.col("n"))).alias("l"))
    long = long.withColumns({"of": parts(F.col("l")), "d": whole((F.col("l") + F.col("n")) * (1 - share))})
    long = long.select("*", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("i"))
    long = long.withColumns({"start": begin(F.col("l"), F.col("i"), F.col("of")), "stop": begin(F.col("l"), F.col("i") + 1, F.col("of"))})
    more = F.col("n") - F.col("l")
    low = F.greatest(F.lit(0), F.col("start") + F.ceil((more - F.col("d")) / 2).cast("int"))
    high = F.least(F.col("n") - (F.col("stop") - F.col("start")), F.col("start") + F.floor((more + F.col("d")) / 2).cast("int"))
    long = long.withColumns({"low": low, "high": high}).filter("low <= high").select("*", F.explode(F.sequence("low", "high")).alias("at"))
    long = long.select("l", "i", F.expr("substring(name, at + 1, stop - start)").alias("part"), F.col("name").alias("longer")).distinct()
    met = short.join(long, ["l", "i", "part"]).filter("shorter <> longer")
    return met.select(F.least("shorter", "longer").alias("src"), F.greatest("shorter", "longer").alias("dst"))


def canonical_names(names: DataFrame, fuzzy: float | None = None) -> DataFrame:
    """(name, canonical) for every registered name: the canonical name of a component is its shortest, then first in order."""
    edges = alias_edges(names).unionByName(duplicate_edges(names))
    if fuzzy is not None:
        edges = edges.unionByName(similar_edges(names, fuzzy))
    parts = connected_components(edges)
    best = parts.groupBy("component").agg(F.min(F.struct(F.length("node").alias("n"), F.col("node").alias("name"))).alias("best"))
    return parts.join(best, "component").select(F.col("node").alias("name"), F.col("best.name").alias("canonical"))


def canonicalize(triples: DataFrame, canonical: DataFrame) -> DataFrame:
    """Triples with head and tail normalized and replaced by their canonical names; those left empty go."""
    names = entity_names(triples).select(F.col("name").alias("raw"), normalize(F.col("name")).alias("name"))
    mapped = names.join(canonical, "name", "left").select("raw", F.coalesce("canonical", "name").alias("to"))
    rows = triples
    for end in ("head", "tail"):
        rows = rows.join(mapped.select(F.col("raw").alias(end), F.col("to").alias(f"{end}_to")), end).drop(end).withColumnRenamed(f"{end}_to", end)
    return rows.filter("head <> '' and tail <> '' and relation <> ''")


def aliases_of(canonical: DataFrame) -> DataFrame:
    return canonical.groupBy("canonical").agg(F.sort_array(F.collect_set("name")).alias("aliases"))
