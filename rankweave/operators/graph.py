"""Weighted matching of terms over a property graph.

edges(edge_id, type, src, dst) link names; has_skill(cid, skill), suitable(cid, role). A path may
visit a node again but not use an edge twice. Walks run backwards from the names that hold a term, depth by
depth and without candidates, so candidates join last and never fan out over hops. Names that hold a term come from an
inverted index of q-grams (names.py); the patterns share one look-up of it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.functions import vocab

from .names import gram_index, holding
from .ranks import small

EACH = 1 << 15  # skills of candidates whose hits a task makes
LINKS = ("RELATED_TO", "BELONGS_TO")
DOMAIN_LINKS = ("HAS_SUBDOMAIN", "BELONGS_TO")


def terms_held(names: DataFrame, name: str, terms: DataFrame) -> DataFrame:
    """(term, name): the different names that hold each term, whatever the case."""
    return holding(gram_index(names.select(name), name), terms)


def _asked(terms: DataFrame, held: DataFrame, name: str, *columns: str) -> DataFrame:
    """(qid, term, columns, name): the rows of `terms` with the names that hold their terms."""
    return held.withColumnRenamed("name", name).join(small(terms.select("qid", "term", *columns).distinct()), "term")


USED = "array<struct<e:string,near:string>>"


def step(state: DataFrame, edges: DataFrame, keys: list[str], left: int, backward: bool = False) -> DataFrame:
    """One more edge of each walk (keys, node, used), with `left` more to come.

    Of the used edges those are kept that could be used again: all while there are several steps left, before the last step
    those that go on from the node, then none. Walks that meet in a node with the same such edges become one row, so
    rows stay far fewer than walks.
    """
    near, far = ("dst", "src") if backward else ("src", "dst")
    follow = edges.select(F.col("edge_id").alias("_e"), F.col(near).alias("_near"), F.col(far).alias("_far"))
    out = state.join(follow, F.col("node") == F.col("_near")).where(~F.exists("used", lambda u: u["e"] == F.col("_e")))
    moved = out.select(*keys, F.col("_far").alias("node"), F.array_append("used", F.struct(F.col("_e").alias("e"), F.col("_near").alias("near"))).alias("used"))
    kept = F.col("used") if left > 1 else F.filter("used", lambda u: u["near"] == F.col("node")) if left else F.array().cast(USED)
    return moved.select(*keys, "node", F.array_sort(kept).alias("used")).distinct()


def walks(edges: DataFrame, depth: int) -> DataFrame:
    """(skill, name): what a directed walk over `depth` different edges reaches."""
    state = edges.select(F.col("src").alias("skill"), F.col("src").alias("node"), F.array().cast(USED).alias("used")).distinct()
    for i in range(depth):
        state = step(state, edges, ["skill"], depth - 1 - i)
    return state.select("skill", F.col("node").alias("name")).distinct()


def sources(edges: DataFrame, terms: DataFrame, depth: int, keep: Callable[[DataFrame], DataFrame] = lambda df: df, held: DataFrame | None = None) -> list[DataFrame]:
    """For each depth from 1: (qid, term, skill) from which a walk over that many different edges reaches a name with the term.

    Names are matched with the terms first, each name once; walks then run backwards from the few that match. `keep`
    may store the states, as each depth goes on from the last. `held` may give terms_held() of these names and others.
    """
    met = _asked(terms, terms_held(edges, "dst", terms) if held is None else held, "node")
    state, out = met.select("qid", "term", "node", F.array().cast(USED).alias("used")), []
    for i in range(depth):
        state = keep(step(state, edges, ["qid", "term"], depth - 1 - i, backward=True))
        out.append(state.select("qid", "term", F.col("node").alias("skill")).distinct())
    return out


def delta(weight: float, hops: int, extra: float = 1.0) -> float:
    return round(weight * extra * vocab.GRAPH_DECAY ** (hops - 1), 4)


def _at(met: DataFrame, node: str, via: str, hops: int, gain: Column) -> DataFrame:
    """(qid, term, skill, node, via, hops, delta): what a skill adds to whoever holds it; `node` names the column that is reported."""
    return met.select("qid", "term", "skill", F.col(node).alias("node"), F.lit(via).alias("via"), F.lit(hops).alias("hops"), gain.alias("delta")).distinct()


def _held(has_skill: DataFrame, at: DataFrame) -> DataFrame:
    """Candidates that hold the skills of _at()."""
    return has_skill.join(small(at), "skill").select("qid", "term", "cid", "node", "via", "hops", "delta").distinct()


def _direct(has_skill: DataFrame, terms: DataFrame, held: DataFrame | None = None) -> DataFrame:
    met = _asked(terms, terms_held(has_skill, "skill", terms) if held is None else held, "skill", "kind")
    gain = F.when(F.col("kind") == "skill", delta(vocab.GRAPH_DIRECT, 1)).otherwise(delta(vocab.GRAPH_RELATED, 1))
    return _at(met, "skill", "HAS_SKILL", 1, gain)


def direct(has_skill: DataFrame, terms: DataFrame) -> DataFrame:
    """One hop: a skill of the candidate holds the term. Skill terms weigh 3, others 1.5."""
    return _held(has_skill, _direct(has_skill, terms))


def _linked(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("type").isin(*LINKS))


def _related(walked: list[DataFrame]) -> DataFrame:
    return _at(walked[0], "skill", "RELATED_TO", 2, F.lit(delta(vocab.GRAPH_RELATED, 2)))


def related(has_skill: DataFrame, edges: DataFrame, terms: DataFrame) -> DataFrame:
    """Two hops: a name next to a skill holds the term; the node is the skill."""
    return _held(has_skill, _related(sources(_linked(edges), terms, 1)))


def _domain(edges: DataFrame, terms: DataFrame, held: DataFrame | None = None) -> DataFrame:
    own = edges.where(F.col("type").isin(*DOMAIN_LINKS)).select(F.col("src").alias("skill"), F.col("dst").alias("name")).distinct()
    met = _asked(terms, terms_held(own, "name", terms) if held is None else held, "name")
    return _at(own.join(met, "name"), "name", "HAS_SUBDOMAIN", 2, F.lit(delta(vocab.GRAPH_DOMAIN, 2)))


def domain(has_skill: DataFrame, edges: DataFrame, terms: DataFrame) -> DataFrame:
    """Two hops to a domain that holds the term; the node is the domain."""
    return _held(has_skill, _domain(edges, terms))


def _role(suitable: DataFrame, terms: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """(qid, term, role, node, via, hops, delta): what a role adds to whoever suits it."""
    met = _asked(terms.where(F.col("kind").isin("role", "skill")), terms_held(suitable, "role", terms) if held is None else held, "role")
    return met.select("qid", "term", "role", F.col("role").alias("node"), F.lit("SUITABLE_FOR").alias("via"), F.lit(1).alias("hops"), F.lit(delta(vocab.GRAPH_ROLE, 1)).alias("delta")).distinct()


def _suited(suitable: DataFrame, met: DataFrame) -> DataFrame:
    """Candidates that suit the roles of _role()."""
    return suitable.join(small(met), "role").select("qid", "term", "cid", "node", "via", "hops", "delta").distinct()


def role(suitable: DataFrame, terms: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """One hop to a role, for role and skill terms."""
    return _suited(suitable, _role(suitable, terms, held))


def _far(walked: list[DataFrame], hops: int) -> DataFrame:
    gain = delta(vocab.GRAPH_RELATED, hops, vocab.GRAPH_DECAY ** (hops - 2))
    return _at(walked[hops - 2], "skill", f"HOP{hops}_CHAIN", hops, F.lit(gain))


def far(has_skill: DataFrame, edges: DataFrame, terms: DataFrame, hops: int) -> DataFrame:
    """Three or four hops: the weight decays once for the distance and once for the hops; the node is the skill."""
    return _held(has_skill, _far(sources(_linked(edges), terms, hops - 1), hops))


def gains(has_skill: DataFrame, suitable: DataFrame, edges: DataFrame, terms: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """What skills add, by all patterns of all terms (qid, term, kind), and what roles add; without candidates.

    Names are made different and looked up once, and the walks of three depths are made once, all stored by `keep`.
    """
    each = [(has_skill, "skill"), (edges, "dst"), (suitable, "role")]
    names = keep(reduce(DataFrame.unionByName, [df.select(F.col(c).alias("name")).distinct() for df, c in each]))
    held = keep(terms_held(names, "name", terms))
    walked = sources(_linked(edges), terms, 3, keep, held)
    at = keep(reduce(DataFrame.unionByName, [_direct(has_skill, terms, held), _related(walked), _domain(edges, terms, held), _far(walked, 3), _far(walked, 4)]))
    return at, keep(_role(suitable, terms, held))


def _dealt(has_skill: DataFrame, *sides: tuple[DataFrame, str]) -> list[DataFrame]:
    """The sides with their columns cid and the named one, by candidate, a task for each `EACH` skills."""
    tasks = 1 + has_skill.count() // EACH
    return [df.select("cid", name).repartition(tasks, "cid") for df, name in sides]


def hits(has_skill: DataFrame, suitable: DataFrame, edges: DataFrame, terms: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """All six patterns for all terms (qid, term, kind).

    What skills add is gathered for all patterns first and joined with their holders once. Skills and roles are dealt by
    candidate, so hits of a candidate meet in the task that made them. They compress so well
    that tasks joined by the size of their shuffles would hold ever more of them.
    """
    at, met = gains(has_skill, suitable, edges, terms, keep)
    skills, roles = _dealt(has_skill, (has_skill, "skill"), (suitable, "role"))
    return _held(skills, at).unionByName(_suited(roles, met))


def hits_of(few: DataFrame, has_skill: DataFrame, suitable: DataFrame, at: DataFrame, met: DataFrame) -> DataFrame:
    """The rows of hits() for some candidates `few` (qid, cid), from gains()."""
    who = small(few.select("cid").distinct())
    found = _held(has_skill.join(who, "cid", "left_semi"), at).unionByName(_suited(suitable.join(who, "cid", "left_semi"), met))
    return found.join(small(few.select("qid", "cid").distinct()), ["qid", "cid"], "left_semi")


def totals(has_skill: DataFrame, suitable: DataFrame, at: DataFrame, met: DataFrame) -> DataFrame:
    """(qid, cid, graph_score) as scored(hits()) gives it, from gains() and without a row for each hit.

    A hit counts once for each node. Where the node is the skill itself, a skill adds the same sum to all who hold it, so the
    sums of a query are made by skill first; domains, which skills share, are made different for each candidate. Sums are in
    whole ten-thousandths, to which every gain is rounded.
    """
    parts = F.sum(F.round(F.col("delta") * 10_000).cast("long")).alias("gain")
    skills, roles = [df.distinct() for df in _dealt(has_skill, (has_skill, "skill"), (suitable, "role"))]
    is_own = F.col("via") != "HAS_SUBDOMAIN"
    own = skills.join(small(at.where(is_own).groupBy("qid", "skill").agg(parts)), "skill").select("qid", "cid", "gain")
    domains = at.where(~is_own).groupBy("qid", "skill", "node").agg(parts)
    shared = skills.join(small(domains), "skill").select("qid", "cid", "node", "gain").distinct().select("qid", "cid", "gain")
    suits = roles.join(small(met.groupBy("qid", "role").agg(parts)), "role").select("qid", "cid", "gain")
    every = own.unionByName(shared).unionByName(suits).groupBy("qid", "cid").agg(F.sum("gain").alias("gain"))
    return every.select("qid", "cid", F.round(F.col("gain") / 10_000, 4).alias("graph_score"))


def scored(found: DataFrame) -> DataFrame:
    """(qid, cid, graph_score, matched_terms, reasons), reasons by gain and hops."""
    reason = F.struct((-F.col("delta")).alias("less"), "hops", F.col("term").alias("query_term"), F.col("node").alias("matched_node"), F.col("via").alias("relationship"))
    out = found.groupBy("qid", "cid").agg(F.round(F.sum("delta"), 4).alias("graph_score"), F.sort_array(F.collect_set("term")).alias("matched_terms"), F.sort_array(F.collect_list(reason)).alias("r"))
    reasons = F.transform("r", lambda x: F.struct(x["query_term"], x["matched_node"], x["relationship"], x["hops"], (-x["less"]).alias("score_delta")))
    return out.select("qid", "cid", "graph_score", "matched_terms", reasons.alias("reasons"))


def experience_score(years, wanted, roles, band):
    """2 within a year of the asked number, 1 within three; a role with a word of the band adds 0.5 once; null years count as 0."""
    gap = F.abs(F.coalesce(years, F.lit(0.0)) - wanted)
    base = F.when(gap <= 1, vocab.YEARS_EXACT).when(gap <= 3, vocab.YEARS_CLOSE).otherwise(0.0)
    words = F.array(F.lower(band))
    for name, listed in vocab.SENIORITY.items():
        words = F.when(F.lower(band) == name, F.array(*map(F.lit, listed))).otherwise(words)
    fits = F.exists(roles, lambda r: F.exists(words, lambda w: F.contains(F.lower(r), w)))
    return base + F.when(band.isNotNull() & F.coalesce(fits, F.lit(False)), vocab.SENIORITY_BONUS).otherwise(0.0)


def judged(scores: DataFrame, has_skill: DataFrame, profiles: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows (qid, cid, graph_score) with the candidates' skills and whole score; those with a negated term in a skill are left out.

    profiles(cid, years, roles array), asked(qid, wanted, band, negated array).
    """
    skills = has_skill.groupBy("cid").agg(F.sort_array(F.collect_set("skill")).alias("core_skills"))
    # Few queries: moved by qid, all candidates of a query would meet in one task.
    out = scores.join(skills, "cid", "left").join(profiles, "cid", "left").join(small(asked), "qid")
    own = experience_score(F.col("years"), F.col("wanted"), F.col("roles"), F.col("band"))
    out = out.withColumn("experience_score", own).withColumn("score", F.round(F.col("graph_score") + own, 4))
    negated = F.exists("core_skills", lambda s: F.exists("negated", lambda n: F.contains(F.lower(s), n)))
    return out.where(~F.coalesce(negated, F.lit(False))).drop("wanted", "band", "negated")


def candidates(found: DataFrame, has_skill: DataFrame, profiles: DataFrame, asked: DataFrame) -> DataFrame:
    """Scored candidates of hits(), with their terms and reasons, as judged() gives them."""
    return judged(scored(found), has_skill, profiles, asked)


def collect_terms(queries: DataFrame) -> DataFrame:
    """(qid, term, kind) from rows (qid, skills, role, band, negated, queries array<struct<query, strategy>>).

    Skills come first, then the role, words of the band, and words of the query variants; the first
    kind of a term stays, negated terms go.
    """
    band_words = F.array().cast("array<string>")
    for name, listed in vocab.SENIORITY.items():
        band_words = F.when(F.lower("band") == name, F.array(*map(F.lit, listed))).otherwise(band_words)
    band_words = F.when(F.col("band").isNull(), F.array().cast("array<string>")).when(F.lower("band").isin(*vocab.SENIORITY), band_words).otherwise(F.array(F.lower("band")))
    item = lambda place, term, kind: F.struct(F.lit(place).alias("place"), term.alias("term"), kind.alias("kind"))
    skills = F.transform(F.coalesce("skills", F.array().cast("array<string>")), lambda s: item(0, F.lower(s), F.lit("skill")))
    role = F.when(F.col("role").isNotNull(), F.array(item(1, F.lower("role"), F.lit("role")))).otherwise(F.array().cast("array<struct<place:int,term:string,kind:string>>"))
    words = F.transform(band_words, lambda w: item(2, w, F.lit("role")))
    tokens = lambda q: F.transform(F.split(F.lower(q["query"]), r"[\s,]+"), lambda t: item(3, F.btrim(t, F.lit(".")), F.when(q["strategy"] == "kg_static", "domain").otherwise("skill")))
    some = F.filter(F.flatten(F.transform("queries", tokens)), lambda t: (F.length(t["term"]) >= 3) & ~t["term"].isin(*vocab.GRAPH_STOP))
    every = queries.select("qid", F.coalesce("negated", F.array().cast("array<string>")).alias("negated"), F.posexplode(F.concat(skills, role, words, some)).alias("at", "t"))
    kept = every.where(~F.array_contains("negated", F.col("t.term"))).groupBy("qid", F.col("t.term").alias("term")).agg(F.min(F.struct("t.place", "at", "t.kind")).alias("m"))
    return kept.select("qid", "term", F.col("m.kind").alias("kind"))


def node_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("label").agg(F.count("*").alias("n"))


def without_candidates(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges without those that leave a candidate in `gone` (cid)."""
    own = edges.where(F.col("type").isin("HAS_SKILL", "SUITABLE_FOR")).join(gone.select(F.col("cid").alias("src")), "src", "left_anti")
    return own.unionByName(edges.where(~F.col("type").isin("HAS_SKILL", "SUITABLE_FOR")))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new`, and those of `old` under other keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def merged(old: DataFrame, batches: list[DataFrame], keys: list[str]) -> DataFrame:
    """MERGE of batches one after the other: a row of a later batch replaces those of its keys; of equal keys in a batch one row, the least, stays."""
    out = old
    for batch in batches:
        rest = [c for c in batch.columns if c not in keys]
        one = batch.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, "_r.*") if rest else batch.distinct()
        out = upsert(out, one.select(*old.columns), keys)
    return out


def read(relations: dict[str, DataFrame], label: str, **equal: object) -> DataFrame:
    """Rows of a node label or an edge type whose columns have the given values: what a graph runner answers."""
    rows = relations[label]
    for name, value in equal.items():
        rows = rows.where(F.col(name).isin(*value) if isinstance(value, (list, tuple)) else F.col(name).eqNullSafe(F.lit(value)))
    return rows


def with_fallback(candidates: DataFrame, graph_skills: DataFrame, table_skills: DataFrame) -> DataFrame:
    """Candidates (cid) with the graph's skills, else those of the profile table; ids are compared as text, whatever their types."""
    one = lambda df, name: df.select(F.col("cid").cast("string").alias("_c"), F.col("skills").alias(name))
    out = candidates.withColumn("_c", F.col("cid").cast("string")).join(one(graph_skills, "_g"), "_c", "left").join(one(table_skills, "_t"), "_c", "left")
    none = F.array().cast("array<string>")
    return out.withColumn("skills", F.when(F.size(F.coalesce("_g", none)) > 0, F.col("_g")).otherwise(F.coalesce("_t", none))).drop("_c", "_g", "_t")
