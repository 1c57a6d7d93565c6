"""Query understanding: batches of query texts to structured columns, without Python on executors.

Vocabularies are arguments; the small defaults are in functions.vocab. Terms are matched as whole
words by equality of word n-grams with the vocabulary, which scales with the text, not the vocabulary.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankweave.functions import vocab
from rankweave.functions.text import let

from .ranks import small

WORD = r"[a-z0-9][a-z0-9+#./-]*"
EACH = 1 << 12  # queries that a task parses


def _strings() -> Column:
    return F.array().cast("array<string>")


def years_asked(text: Column) -> Column:
    found = F.regexp_extract(F.lower(text), vocab.YEARS, 1)
    return F.when(found != "", found)


def band(text: Column, bands: Mapping[str, Sequence[str]] = vocab.BANDS) -> Column:
    """The first band, in order, with a pattern in the text."""
    q, out = F.lower(text), None
    for name, patterns in bands.items():
        hit = F.lit(False)
        for p in patterns:
            hit = hit | q.rlike(p)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def first_contained(text: Column, terms: Mapping[str, Sequence[str]]) -> Column:
    """The first key, in order, that is part of the text or has a variant that is."""
    q, out = F.lower(text), None
    for name, variants in terms.items():
        hit = F.contains(q, F.lit(name))
        for v in variants:
            hit = hit | F.contains(q, F.lit(v))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def location(text: Column, places: Sequence[str] = vocab.PLACES) -> Column:
    return first_contained(text, {p: [] for p in places})


def replace_aliases(text: Column, aliases: Mapping[str, str]) -> Column:
    """Whole-word aliases as their canonical names, longer ones first, then by name."""
    out = text
    for name in sorted(aliases, key=lambda a: (-len(a.split()), -len(a), a)):
        out = F.regexp_replace(out, rf"(?i)\b{_escaped(name)}\b", aliases[name])
    return out


def _escaped(term: str) -> str:
    return "".join(c if c.isalnum() or c == " " else "\\" + c for c in term)


def ngrams(text: Column, longest: int = 4) -> Column:
    """All runs of 1 to `longest` words."""
    words = F.transform(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), lambda w: F.rtrim(w, F.lit("./-")))

    def runs(w: Column, k: int) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, k), " "))
        return F.when(F.size(w) >= k, each).otherwise(_strings())

    return let(words, lambda w: F.array_distinct(F.flatten(F.array(*[runs(w, k) for k in range(1, longest + 1)]))))


def _listed(hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, found) of (keys, term, canonical): canonical names, longer terms first, then by name."""
    best = hits.groupBy(*keys, "canonical").agg(F.min(F.struct((-F.size(F.split("term", " "))).alias("less"), "term")).alias("m"))
    found = best.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("m.less", "m.term", "canonical"))).alias("l"))
    return found.select(*keys, F.transform("l", lambda x: x["canonical"]).alias("found"))


def terms_in(queries: DataFrame, vocabulary: DataFrame, key: str = "qid", text: str = "text") -> DataFrame:
    """(qid, found): canonical names of vocabulary terms (term, canonical) in each text; longer terms first, then by name."""
    grams = queries.select(key, F.explode(ngrams(F.col(text))).alias("term"))
    return _listed(grams.join(small(vocabulary), "term"), [key])


def terms_of_kinds(queries: DataFrame, vocabularies: Mapping[str, DataFrame], key: str = "qid", text: str = "text") -> DataFrame:
    """(qid, a column of each kind): as terms_in of several vocabularies, with the runs of words made once; null where none is found."""
    known = None
    for kind, df in vocabularies.items():
        one = df.select(F.lit(kind).alias("_kind"), "term", "canonical")
        known = one if known is None else known.unionByName(one)
    grams = queries.select(key, F.explode(ngrams(F.col(text))).alias("term"))
    found = _listed(grams.join(small(known), "term"), [key, "_kind"])
    return found.groupBy(key).agg(*[F.max(F.when(F.col("_kind") == kind, F.col("found"))).alias(kind) for kind in vocabularies])


def vocabulary(spark, terms: Sequence[str], aliases: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """(term, canonical) of terms and their aliases; a later alias of one term wins."""
    rows = {t.lower(): t.lower() for t in terms}
    for name, others in (aliases or {}).items():
        rows[name] = name
        rows |= {o.lower(): name for o in others}
    return spark.createDataFrame(sorted(rows.items()), "term string, canonical string")


def negated_spans(text: Column) -> Column:
    """Array of (start, end), 0-based: each trigger with the words that it covers."""
    return let(F.lower(text), lambda q: F.flatten(F.array(*[_spans_of(q, pattern, scope) for pattern, scope in vocab.NEGATIONS])))


def _spans_of(q: Column, pattern: str, scope: int) -> Column:
    """Each match of the trigger with what follows it up to the next words of its scope."""
    none = F.array().cast("array<struct<start:int,end:int>>")

    def each(hits: Column, head: Column) -> Column:
        # Where a match starts: the lengths of what is before it and between.
        lengths = lambda a, n: F.aggregate(F.slice(a, 1, n), F.lit(0), lambda so_far, x: so_far + F.length(x))
        start = lambda i: lengths(head, i + 1) + lengths(hits, i)
        return F.transform(F.sequence(F.lit(0), F.size(hits) - 1), lambda i: let(start(i), lambda at: _span(q, at, F.length(F.get(hits, i)), scope)))

    found = F.regexp_extract_all(q, F.lit(f"({pattern})"), F.lit(1))
    return let(found, lambda hits: F.when(F.size(hits) > 0, let(F.split(q, pattern), lambda head: each(hits, head))).otherwise(none))


def _span(q: Column, start: Column, size: Column, scope: int) -> Column:
    rest = F.trim(F.substring(q, start + size + 1, F.length(q)))
    covered = F.array_join(F.slice(F.split(rest, r"\s+"), 1, scope), " ")
    return F.struct(start.alias("start"), (start + size + F.length(covered)).alias("end"))


def negated(text: Column, skills: Column, spans: Column | None = None) -> Column:
    """Skills whose first place in the text lies in a negated span; `spans` are those of the text where they are known."""
    inside = lambda at, p: (at >= p["start"]) & (at <= p["end"])
    held = lambda q, spans: F.filter(skills, lambda s: let(F.instr(q, s), lambda at: (at > 0) & F.exists(spans, lambda p: inside(at - 1, p))))
    return let(F.lower(text), lambda q: let(negated_spans(text) if spans is None else spans, lambda x: held(q, x)))


def exclusions(negated_skills: Column, negated_location: Column) -> Column:
    """The exclusion filter; a part without content is null."""
    return F.struct(F.when(F.size(negated_skills) > 0, negated_skills).alias("must_not_skills"), negated_location.alias("must_not_location"))


def negated_location(text: Column, spans: Column | None = None) -> Column:
    modes = F.filter(F.array(*map(F.lit, vocab.WORK_MODES)), lambda m: F.contains(F.lower(text), m))
    return F.get(negated(text, modes, spans), F.lit(0))


def rules_matched(text: Column, suppressed: Column | None = None) -> Column:
    """Intents with a rule in the text, in order of the rules, without suppressed ones."""
    q = F.lower(text)
    hit = []
    for name, patterns in vocab.RULES:
        any_ = F.lit(False)
        for p in patterns:
            any_ = any_ | q.rlike(p)
        hit.append(F.when(any_, F.lit(name)))
    out = F.array_compact(F.array(*hit))
    return out if suppressed is None else F.array_except(out, suppressed)


def intent(text: Column, skills: Column, role: Column, band_: Column, domain: Column, suppressed: Column) -> Column:
    """struct(primary, confidence, modifiers) by entities, else by rules, else unknown at 0.5."""
    n = F.size(skills)
    free = lambda name: ~F.array_contains(suppressed, name)
    pick = lambda *pairs: F.array_except(F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in pairs])), suppressed)
    made = lambda name, confidence, modifiers: F.struct(name.alias("primary"), F.lit(confidence).alias("confidence"), modifiers.alias("modifiers"))

    def by_rules(rules: Column) -> Column:
        rest = F.slice(rules, 2, F.greatest(F.size(rules), F.lit(1)))
        more = F.when(domain.isNotNull() & ~F.array_contains(rules, "domain_search") & free("domain_search"), F.array_append(rest, F.lit("domain_search"))).otherwise(rest)
        return F.when(F.size(rules) > 0, made(F.get(rules, F.lit(0)), 0.93, more)).otherwise(made(F.lit("unknown"), 0.5, _strings()))

    return (
        F.when((n >= 2) & free("multi_skill"), made(F.lit("multi_skill"), 0.92, pick((band_.isNotNull(), "experience_filter"), (domain.isNotNull(), "domain_search"))))
        .when(band_.isNotNull() & ((n >= 1) | role.isNotNull()) & free("experience_filter"), made(F.lit("experience_filter"), 0.91, pick((n >= 1, "skill_search"), (role.isNotNull(), "role_search"), (domain.isNotNull(), "domain_search"))))
        .when(domain.isNotNull() & band_.isNull() & (n <= 1) & free("domain_search"), made(F.lit("domain_search"), 0.88, pick((role.isNotNull(), "role_search"))))
        .otherwise(let(rules_matched(text, suppressed), by_rules))
    )


def parse(queries: DataFrame, skills: DataFrame, roles: DataFrame, domains: Mapping[str, Sequence[str]] = vocab.DOMAINS, key: str = "qid", text: str = "text", each: int = EACH) -> DataFrame:
    """(qid, text, skills, negated, role, band, years, domain, location, negated_location, intent) of each query.

    Queries are dealt by their key, about `each` to a task: parsing takes far more time than reading them, so their bytes, by which
    Spark would join partitions, say little. All that follows of a query stays in its task.
    """
    own = queries.select(key, text).repartition(1 + queries.count() // each, key)
    found = own.join(terms_of_kinds(own, {"_s": skills, "_r": roles}, key, text), key, "left")
    t = F.col(text)
    out = found.select(key, text, F.coalesce("_s", _strings()).alias("all_skills"), F.get("_r", F.lit(0)).alias("role"), band(t).alias("band"), years_asked(t).alias("years"), first_contained(t, domains).alias("domain"), location(t).alias("place"), negated_spans(t).alias("_spans"))
    spans = F.col("_spans")
    out = out.withColumn("negated_location", negated_location(t, spans)).withColumn("negated", negated(t, F.col("all_skills"), spans)).withColumn("skills", F.array_except("all_skills", "negated"))
    suppressed = F.array_compact(F.array(F.when(F.col("negated_location").isNotNull(), F.lit("availability")), F.when(F.size("negated") > 0, F.lit("skill_search"))))
    return out.withColumn("intent", intent(t, F.col("skills"), F.col("role"), F.col("band"), F.col("domain"), suppressed)).withColumn("exclusions", exclusions(F.col("negated"), F.col("negated_location"))).drop("all_skills", "_spans")


def synonym_variants(parsed: DataFrame, aliases: Mapping[str, Sequence[str]] = vocab.SKILL_ALIASES, each: int = 2) -> DataFrame:
    """(qid, place, query, strategy): the text with a skill replaced by each of its first aliases."""
    rows = [(skill, i, a) for skill, listed in aliases.items() for i, a in enumerate(listed[:each])]
    side = parsed.sparkSession.createDataFrame(rows, "skill string, i int, alias string")
    hits = parsed.select("qid", "text", F.posexplode("skills").alias("at", "skill")).join(F.broadcast(side), "skill")
    new = F.regexp_replace(F.col("text"), F.concat(F.lit(r"\b\Q"), "skill", F.lit(r"\E\b")), F.col("alias"))
    return hits.withColumn("query", new).where(F.col("query") != F.col("text")).select("qid", (100 + F.col("at") * each + F.col("i")).alias("place"), "query", F.lit("synonym").alias("strategy"))


def relation_variants(parsed: DataFrame, relations: Mapping[str, Sequence[str]] = vocab.RELATIONS) -> DataFrame:
    """Sentences with a skill's three first relations, and one with the role."""
    side = parsed.sparkSession.createDataFrame([(s, list(r[:3])) for s, r in relations.items()], "skill string, near array<string>")
    hits = parsed.select("qid", "role", F.posexplode("skills").alias("at", "skill")).join(F.broadcast(side), "skill")
    one = F.concat(F.lit("candidate skilled in "), F.array_join(F.concat(F.array("skill"), "near"), ", "))
    two = F.concat("role", F.lit(" with "), "skill", F.lit(" and "), F.get("near", F.lit(0)), F.lit(" experience"))
    return hits.select("qid", "at", F.posexplode(F.array_compact(F.array(one, two))).alias("i", "query")).select("qid", (200 + F.col("at") * 2 + F.col("i")).alias("place"), "query", F.lit("kg_static").alias("strategy"))


def template_variants(parsed: DataFrame, templates: Mapping[str, Sequence[str]] = vocab.TEMPLATES, each: int = 2) -> DataFrame:
    """Two templates of the intent and of each modifier, filled."""
    rows = [(name, i, t) for name, listed in templates.items() for i, t in enumerate(listed[:each])]
    side = parsed.sparkSession.createDataFrame(rows, "name string, i int, template string")
    intents = F.concat(F.array("intent.primary"), "intent.modifiers")
    hits = parsed.withColumn("_i", intents).select("*", F.posexplode("_i").alias("at", "name")).join(F.broadcast(side), "name")
    filled = F.col("template")
    values = {"query": F.col("text"), "skills": F.array_join("skills", " "), "role": F.col("role"), "experience_band": F.col("band"), "experience_years": F.col("years"), "domain": F.col("domain"), "location": F.col("place")}
    for slot, value in values.items():
        filled = F.replace(filled, F.lit("{" + slot + "}"), F.coalesce(value, F.lit("")))
    out = hits.withColumn("query", F.trim(filled)).where((F.col("query") != F.col("text")) & (F.replace("query", F.lit(" "), F.lit("")) != ""))
    return out.select("qid", (300 + F.col("at") * each + F.col("i")).alias("place"), "query", F.lit("template").alias("strategy"))


def skill_variants(parsed: DataFrame) -> DataFrame:
    """One query a skill; what stands in where no service decomposes queries."""
    return parsed.select("qid", "band", F.posexplode("skills").alias("at", "skill")).select("qid", (250 + F.col("at")).alias("place"), F.trim(F.concat("skill", F.lit(" developer "), F.coalesce("band", F.lit("")))).alias("query"), F.lit("decomposition").alias("strategy"))


def admitted(variants: DataFrame, most: int = vocab.MOST_VARIANTS) -> DataFrame:
    """Trimmed, lower-case variants of over 3 characters, each text once under its first strategy, `most` a query."""
    own = variants.withColumn("query", F.lower(F.trim("query"))).where(F.length("query") > 3)
    first = own.groupBy("qid", "query").agg(F.min(F.struct("place", "strategy")).alias("m")).select("qid", "query", "m.place", "m.strategy")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("place", "query"))
    return first.withColumn("ord", rank).where(F.col("ord") <= most).select("qid", "ord", "query", "strategy")


def expand(parsed: DataFrame, most: int = vocab.MOST_VARIANTS, extra: DataFrame | None = None) -> DataFrame:
    """(qid, ord, query, strategy): all variants of parsed queries; `extra` rows (qid, place, query, strategy) come from an outside service."""
    own = parsed.select("qid", F.lit(0).alias("place"), F.col("text").alias("query"), F.lit("original").alias("strategy"))
    every = own.unionByName(synonym_variants(parsed)).unionByName(relation_variants(parsed)).unionByName(template_variants(parsed))
    return admitted(every if extra is None else every.unionByName(extra), most)


def without_negated(variants: DataFrame, parsed: DataFrame) -> DataFrame:
    """Variants that hold no negated skill; the query itself where none is left. Variants are read once."""
    held = parsed.select("qid", "negated", "text").join(variants, "qid", "left")
    good = F.coalesce(F.col("query").isNotNull() & ~F.exists("negated", lambda n: F.contains(F.col("query"), n)), F.lit(False))
    own = Window.partitionBy("qid")
    marked = held.withColumn("_good", good).withColumn("_any", F.max("_good").over(own)).withColumn("_at", F.row_number().over(own.orderBy("ord")))
    kept = marked.where(F.col("_good") | (~F.col("_any") & (F.col("_at") == 1)))
    or_own = lambda c, other: F.when(F.col("_good"), F.col(c)).otherwise(other).alias(c)
    return kept.select("qid", or_own("ord", F.lit(1)), or_own("query", F.lower("text")), or_own("strategy", F.lit("original")))


def synonym_table(spark, groups: Sequence[Sequence[str]] = vocab.SYNONYMS) -> DataFrame:
    """(term, canonical, synonym, place) of synonym groups."""
    rows = [(t, g[0], s, i) for g in groups for t in g for i, s in enumerate(x for x in g if x != t)]
    return spark.createDataFrame(rows, "term string, canonical string, synonym string, place int")


def dictionary(lists: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """(term, kind) of several lists (term): terms in lower case; the first list that has a term names its kind."""
    every = None
    for place, (kind, df) in enumerate(lists):
        one = df.select(F.lower(F.trim("term")).alias("term"), F.struct(F.lit(place).alias("place"), F.lit(kind).alias("kind")).alias("m")).where("term <> ''")
        every = one if every is None else every.unionByName(one)
    return every.groupBy("term").agg(F.min("m").alias("m")).select("term", "m.kind")


def load_vocabulary(spark, path: str) -> DataFrame:
    """(term, canonical) of a vocabulary file, JSON lines of {"term": ..., "aliases": [...]}; an alias that is a term of its own stays one."""
    rows = spark.read.schema("term string, aliases array<string>").json(path)
    own = rows.select(F.lower("term").alias("term"), F.lower("term").alias("canonical"), F.lit(0).alias("place"))
    other = rows.select(F.explode("aliases").alias("a"), F.lower("term").alias("canonical")).select(F.lower("a").alias("term"), "canonical", F.lit(1).alias("place"))
    best = own.unionByName(other).groupBy("term").agg(F.min(F.struct("place", "canonical")).alias("m"))
    return best.select("term", F.col("m.canonical").alias("canonical"))


def concatenated(standard: Column, related: Column) -> Column:
    """Standard variants, then those of related technologies; a repeated one keeps its first place."""
    return F.array_distinct(F.concat(F.coalesce(standard, _strings()), F.coalesce(related, _strings())))


def query_skills(queries: DataFrame, known: DataFrame, tokens: Callable[[Column], Column], names: Sequence[Callable[[Column], Column]], key: str = "qid", text: str = "text") -> DataFrame:
    """(qid, skill): tokens of a query that are, under one of the name rules, known skills."""
    each = queries.select(key, F.explode(tokens(F.col(text))).alias("_t"))
    made = each.select(key, F.explode(F.array(*[f(F.col("_t")) for f in names])).alias("skill")).distinct()
    return made.join(known.select("skill").distinct(), "skill", "left_semi").select(key, "skill")


def top_intents(scored: DataFrame, keys: Sequence[str], k: int = 3) -> DataFrame:
    """(keys, intent, score, place): of hypotheses (keys, intent, score) each intent's best, and of these the k best; ties by name."""
    best = scored.groupBy(*keys, "intent").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "intent"))
    return best.withColumn("place", place).where(F.col("place") <= k)


def judged(top: DataFrame, keys: Sequence[str], primary: float = 0.4, modifier: float = 0.3) -> DataFrame:
    """(keys, intent, confidence, modifiers): the first intent where it reaches `primary`, else unknown at 0.5; others that reach `modifier` follow."""
    listed = top.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("place", "intent", "score"))).alias("l"))
    first = F.get("l", F.lit(0))
    enough = first["score"] >= primary
    more = F.transform(F.filter(F.slice("l", 2, 2), lambda x: x["score"] >= modifier), lambda x: x["intent"])
    return listed.select(*keys, F.when(enough, first["intent"]).otherwise("unknown").alias("intent"), F.when(enough, first["score"]).otherwise(0.5).alias("confidence"), F.when(enough, more).otherwise(F.slice(more, 1, 0)).alias("modifiers"))


def answers(column: Column, schema: str) -> Column:
    """Fields of a service's JSON answer, code fences cut; null where it is not JSON of the schema."""
    clean = F.trim(F.regexp_replace(column, r"```(?:json)?|```", ""))
    return F.from_json(clean, schema, {"mode": "PERMISSIVE"})


def call_service(rows: DataFrame, prompt: str, service: Callable[[str], str] | None, out: str = "answer") -> DataFrame:
    """An injected service over a prompt column in Arrow batches; without one, null."""
    if service is None:
        return rows.withColumn(out, F.lit(None).cast("string"))

    @F.pandas_udf("string")
    def run(texts):
        return texts.map(service)

    return rows.withColumn(out, run(F.col(prompt)))
