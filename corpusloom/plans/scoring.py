"""Rule-driven labels and scores. The rules below are small neutral tables of the shape the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import scoring, tagging
from corpusloom.plans.book import query
from corpusloom.session import read

RULES: list[tuple[str, list[str]]] = [
    ("virtue", [r"\bpatience\b", r"\bhumility\b", r"\bmeekness\b", r"\bcharity\b"]),
    ("trade", [r"\bweavers?\b", r"\bmillers?\b", r"\bcoopers?\b", r"\btinners?\b"]),
    ("grief", [r"\bsorrow\b", r"\baffliction\b", r"\bmourn[a-z]*\b", r"\bwept\b"]),
    ("house", [r"\bkitchen\b", r"\bparlour\b", r"\bcellar\b", r"\btable\b"]),
    ("journey", [r"\brode to\b", r"\bcame to\b", r"\bmiles from\b"]),
]
SCALE = scoring.Scale(
    dimensions=(
        scoring.RuleSet("grace", ("free mercy", "mercy", "forgiveness", "assurance"), (r"\b(grace|pardon|forgiv|justif)\w*\b", r"\bnew[ -]birth\b"), 3, 15.0),
        scoring.RuleSet("holiness", ("holiness of heart", "holiness", "righteousness", "meekness"), (r"\b(holy|holiness|perfect)\w*\b", r"\bpure\b"), 3, 15.0),
        scoring.RuleSet("experience", ("wept", "rejoiced", "heart-searching"), (r"\bi\s+felt\b", r"\b(joyful|wept|trembled)\b"), 3, 18.0),
        scoring.RuleSet("fellowship", ("charity", "fellowship", "class-meeting", "love-feast"), (r"\bone\s+body\b", r"\bbrethren\b"), 4, 10.0),
        scoring.RuleSet("social", ("the poor", "beggar", "prisoner", "almshouse"), (r"\b(hungry|widow|orphan)s?\b", r"\bpoor-box\b"), 3, 15.0),
    ),
    allusions=(r"\bit is written\b", r"\b(as the apostle|the text) says\b"),
    curated=("patience", "watch-night", "field-preaching"),
    terms=("providence", "gratitude", "weaver", "chapel", "preacher", "steward", "meeting-house", "temperance"),
    counter=scoring.Counter("counter", ("covetousness", "unbelief"), (r"\b(idleness|pride|vanity)\b", r"\bbondage\b"), refutations=(r"\b(free\s+mercy|perfect\s+love|liberty|deliverance)\b",)),
    labels=((0, "none"), (10, "slight"), (25, "some"), (40, "fair"), (55, "strong"), (65, "great"), (75, "deep"), (82, "full")),
    rhetoric=(r"\b(brethren|beloved|my\s+friends)\b", r"\bnot\s+\w+\s+but\s+\w+\b", r"\b(let\s+us|take\s+heed|consider|observe)\b"),
)


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", "text")


def _hits(patterns: list[str], text: str = "l") -> str:
    return " + ".join(f"len(regexp_extract_all({text}, '{p}'))" for p in patterns)


_TOP = f"""SELECT doc_id, list_transform(list_slice(list_sort(list_filter([{", ".join(f"{{hits: -({_hits(p)}), k: {k}, label: '{label}'}}" for k, (label, p) in enumerate(RULES))}], lambda s: s.hits < 0)), 1, 3), lambda s: s.label) AS labels
FROM (SELECT doc_id, lower(text) AS l FROM documents WHERE text IS NOT NULL)"""


@query(f"SELECT doc_id, array_to_string(labels, ',') AS labels FROM ({_TOP})")
def theme_tagging_top3(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("doc_id", F.array_join(tagging.top_labels(F.col("text"), RULES), ",").alias("labels"))


@query(f"SELECT doc_id FROM (SELECT doc_id, lower(text) AS l FROM documents WHERE text IS NOT NULL) WHERE regexp_matches(l, '{'|'.join(RULES[2][1])}')")
def any_pattern(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).where(tagging.any_pattern(F.col("text"), RULES[2][1])).select("doc_id")


@query(f"""
WITH p AS (SELECT id, min(text) AS text, max(coalesce(themes, [])) AS themes FROM passages GROUP BY id),
t AS (SELECT id, CASE WHEN len(themes) = 0 THEN list_transform(list_slice(list_sort(list_filter([{", ".join(f"{{hits: -({_hits(p, 'lower(text)')}), k: {k}, label: '{label}'}}" for k, (label, p) in enumerate(RULES))}], lambda s: s.hits < 0)), 1, 3), lambda s: s.label) ELSE themes END AS themes FROM p)
SELECT id, array_to_string(list_transform(themes, lambda x: coalesce(x, '?')), ',') AS themes FROM t""")
def tagged_untagged(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "passages", "id", "text", "themes").groupBy("id").agg(F.min("text").alias("text"), F.max(F.coalesce("themes", F.array().cast("array<string>"))).alias("themes"))
    t = tagging.tag_untagged(p.where("text is not null"), RULES).unionByName(p.where("text is null"))
    return t.select("id", F.array_join(F.transform("themes", lambda x: F.coalesce(x, F.lit("?"))), ",").alias("themes"))


_REVIEW = [[r"\bpatien", r"\bwait"], [r"\bcharit", r"\bpoor\b"], [r"\bsorrow", r"\bmourn", r"\bwept\b"]]
_SUGGEST = [("hope", [r"\bhope\b", r"\bassurance\b"]), ("trade", [r"\bweaver\b", r"\bmiller\b"])]
_KEYWORDS = [("mercy", r"\bmercy\b"), ("house", r"\bkitchen\b|\bcellar\b")]
_BY_KEYWORD = [("mercy", "grace"), ("house", "home")]
_THEME = [f"(SELECT min(theme_id) FROM themes WHERE theme_id > {prev})" for prev in ("''", "(SELECT min(theme_id) FROM themes)", "(SELECT min(theme_id) FROM themes WHERE theme_id > (SELECT min(theme_id) FROM themes))")]
_MEETS = [f"coalesce(regexp_matches(l, '{'|'.join(p)}'), false)" for p in _REVIEW]
_REVIEWED = f"""
SELECT id, themes, list_filter(themes, lambda t: NOT coalesce(list_contains(failing, t), false)) AS kept, list_concat(list_transform(failing, lambda t: 'over-tagged: ' || t), list_transform(untitled, lambda t: 'title: ' || t)) AS issues,
  CASE WHEN regexp_matches(l, '{'|'.join(_SUGGEST[0][1])}') THEN 'hope' WHEN regexp_matches(l, '{'|'.join(_SUGGEST[1][1])}') THEN 'trade' WHEN regexp_matches(l, '{_KEYWORDS[0][1]}') THEN 'grace' WHEN regexp_matches(l, '{_KEYWORDS[1][1]}') THEN 'home' ELSE 'general' END AS better
FROM (SELECT *, list_filter([{", ".join(f"CASE WHEN NOT {m} AND list_contains(themes, {t}) THEN {t} END" for m, t in zip(_MEETS, _THEME))}], lambda t: t IS NOT NULL) AS failing,
  list_filter([CASE WHEN contains(lower(title), 'sermon') AND NOT list_contains(themes, {_THEME[0]}) AND {_MEETS[0]} THEN {_THEME[0]} END, CASE WHEN contains(lower(title), 'hope') AND NOT list_contains(themes, {_THEME[1]}) THEN {_THEME[1]} END], lambda t: t IS NOT NULL) AS untitled
  FROM (SELECT id, lower(min(text)) AS l, max(themes) AS themes, min(source_title) AS title FROM passages GROUP BY id) WHERE themes IS NOT NULL)"""
_DONE = f"(SELECT id, themes, issues, CASE WHEN len(kept) = 0 AND len(issues) > 0 THEN [better] ELSE kept END AS reviewed FROM ({_REVIEWED}))"


def _reviewed(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "passages", "id", "text", "themes", "source_title").groupBy("id").agg(F.min("text").alias("text"), F.max("themes").alias("themes"), F.min("source_title").alias("source_title"))
    ids = [r.theme_id for r in read(spark, d, "themes", "theme_id").where("theme_id is not null").distinct().orderBy("theme_id").limit(len(_REVIEW)).collect()]
    titles = [("sermon", ids[0], True), ("hope", ids[1], False)]
    return tagging.review(p.where("themes is not null"), dict(zip(ids, _REVIEW)), "general", _SUGGEST, _KEYWORDS, _BY_KEYWORD, titles)


@query(f"""
SELECT theme, CAST(sum(removed) AS BIGINT) AS removed, CAST(sum(added) AS BIGINT) AS added FROM (
  SELECT unnest(list_distinct(list_filter(themes, lambda t: NOT coalesce(list_contains(reviewed, t), false)))) AS theme, 1 AS removed, 0 AS added FROM {_DONE}
  UNION ALL SELECT unnest(list_distinct(list_filter(reviewed, lambda t: NOT coalesce(list_contains(themes, t), false)))), 0, 1 FROM {_DONE}) WHERE theme IS NOT NULL GROUP BY theme""")
def theme_review(spark: SparkSession, d: str) -> DataFrame:
    """Themes removed and added by a review of each theme against its rule."""
    return tagging.review_deltas(_reviewed(spark, d))


@query(f"SELECT id, array_to_string(issues, '; ') AS issues FROM {_DONE} WHERE len(issues) > 0")
def theme_issues(spark: SparkSession, d: str) -> DataFrame:
    """What the review finds: themes the text doesn't bear out, themes its title asks for."""
    return _reviewed(spark, d).where(F.size("issues") > 0).select("id", F.array_join("issues", "; ").alias("issues"))


@query(f"""
SELECT doc_id, array_to_string(list_filter([{", ".join(f"CASE WHEN regexp_matches(l, '{p}') THEN '{n}' END" for n, p in _KEYWORDS)}], lambda x: x IS NOT NULL), ',') AS flags,
  array_to_string(list_filter([{", ".join(f"CASE WHEN regexp_matches(l, '{'|'.join(p)}') THEN '{n}' END" for n, p in _SUGGEST)}], lambda x: x IS NOT NULL), ',') AS suggested FROM (SELECT doc_id, lower(text) AS l FROM documents WHERE text IS NOT NULL)""")
def keyword_flags(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return _texts(spark, d).select("doc_id", F.array_join(tagging.flags(t, _KEYWORDS), ",").alias("flags"), F.array_join(tagging.suggested(t, _SUGGEST), ",").alias("suggested"))


# The SQL below states the arithmetic again, from its description and not from the operators.


def _phrases_sql(phrases: tuple[str, ...]) -> str:
    return " + ".join(f"(length(l) - length(replace(l, '{p}', ''))) / {len(p)}" for p in phrases) or "0"


def _patterns_sql(patterns: tuple[str, ...]) -> str:
    return " + ".join(f"len(regexp_extract_all(l, '{p}'))" for p in patterns) or "0"


def _score_sql(raw: str, density: float) -> str:
    curve = lambda x, most: f"100 * (1 - exp(-3 * least({x} / {most}, 1.0)))"
    return f"CAST(least(trunc(round(greatest({curve(f'(({raw}) / greatest(words / 100.0, 1.0))', density)}, {curve(f'({raw})', 30.0)}), 9)), 100) AS INT)"


_RAW_SQL = ", ".join(
    [f"({_phrases_sql(x.phrases)}) * {x.phrase_weight} + {_patterns_sql(x.patterns)} AS r_{x.name}" for x in SCALE.dimensions]
    + [f"len(regexp_extract_all(l, '{scoring.reference_pattern()}')) * 2 + {_patterns_sql(SCALE.allusions)} AS r_scripture"]
    + [f"({_phrases_sql(SCALE.curated)}) * 2 + {_phrases_sql(SCALE.terms)} AS r_vocabulary"]
    + [f"CAST(greatest(0, ({_phrases_sql(SCALE.counter.phrases)}) * 3 + {_patterns_sql(SCALE.counter.patterns)} - 3 * ({_patterns_sql(SCALE.counter.refutations)})) AS INT) AS counter"]
)
_WORDS_SQL = "len(list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\v\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{1c}-\\x{1f}]+'), lambda w: w <> ''))"
_NAMES = SCALE.scored()
_THEOLOGY = [x.name for x in SCALE.dimensions]


def scored_sql(source: str, key: str) -> str:
    """SQL of the whole scale over ``source`` (key, text): scores, counter, penalty, overall, label, words."""
    each = ", ".join([f"{_score_sql(f'r_{x.name}', x.max_density)} AS {x.name}" for x in SCALE.dimensions] + [f"{_score_sql('r_scripture', 12.0)} AS scripture", f"{_score_sql('r_vocabulary', 25.0)} AS vocabulary"])
    label = "CASE " + " ".join(f"WHEN overall >= {t} THEN '{x}'" for t, x in sorted(SCALE.labels, reverse=True)) + " END"
    return f"""
SELECT *, {label} AS label FROM (SELECT *, least(greatest(CAST(trunc(round(theology * 0.6 + scripture * 0.2 + vocabulary * 0.2, 9)) AS INT) - penalty_applied, 0), 100) AS overall FROM (
SELECT *, CASE WHEN theology >= 60 THEN least(penalty, 5) WHEN theology >= 40 THEN least(penalty, 10) ELSE penalty END AS penalty_applied FROM (
SELECT *, least(100, greatest({", ".join(_THEOLOGY)}) + least(5 * ({" + ".join(f"CASE WHEN {n} >= 15 THEN 1 ELSE 0 END" for n in _THEOLOGY)}), 20)) AS theology,
  CASE WHEN counter = 0 THEN 0 WHEN counter <= 2 THEN 5 WHEN counter <= 5 THEN 10 WHEN counter <= 10 THEN 15 WHEN counter <= 20 THEN 20 ELSE 25 END AS penalty FROM (
SELECT *, {each} FROM (SELECT *, {_RAW_SQL} FROM (SELECT {key}, lower(text) AS l, text, {_WORDS_SQL} AS words FROM {source} WHERE text IS NOT NULL))))))"""


_SCORED = scored_sql("documents", "doc_id")


@query(f"SELECT doc_id, {', '.join(_NAMES)}, penalty_applied, overall, label FROM ({_SCORED})")
def affinity_score(spark: SparkSession, d: str) -> DataFrame:
    return scoring.with_scores(_texts(spark, d), SCALE).select("doc_id", *_NAMES, "penalty_applied", "overall", "label")


@query(f"""SELECT doc_id, counter, round(counter / greatest(words / 100.0, 1.0), 1) AS density, penalty FROM ({_SCORED})""")
def counter_penalty(spark: SparkSession, d: str) -> DataFrame:
    """Hits, density (to one place) and penalty of the counter-markers."""
    s = scoring.with_scores(_texts(spark, d), SCALE)
    return s.select("doc_id", "counter", F.round(scoring.per_hundred(F.col("counter"), F.col("words")), 1).alias("density"), "penalty")


_RANKED = "list_sort([" + ", ".join(f"{{s: -{n}, k: {k}, n: '{n}'}}" for k, n in enumerate(_NAMES)) + "])"


@query(f"""
SELECT doc_id, overall, 'This text scores ' || overall || '/100 (' || label || ').'
  || CASE WHEN len(hi) > 0 THEN ' It shows strongest affinity in ' || array_to_string(list_transform(hi[1:3], lambda r: r.n), ', ') || '.' ELSE '' END
  || CASE WHEN len(hi) > 0 AND len(lo) BETWEEN 1 AND {len(_NAMES) - 1} THEN ' It lacks emphasis on ' || array_to_string(list_transform(lo[1:2], lambda r: r.n), ', ') || '.' ELSE '' END
  || CASE WHEN penalty_applied > 0 THEN ' Score reduced by ' || penalty_applied || ' points for counter-markers (' || counter || ' found).' ELSE '' END AS summary
FROM (SELECT *, list_filter(ranked, lambda r: r.s <= -50) AS hi, list_filter(ranked, lambda r: r.s > -20) AS lo FROM (SELECT *, {_RANKED} AS ranked FROM ({_SCORED})))""")
def affinity_summary(spark: SparkSession, d: str) -> DataFrame:
    """The score in words."""
    return scoring.with_scores(_texts(spark, d), SCALE).select("doc_id", "overall", scoring.summary(SCALE).alias("summary"))


@query(rf"""
SELECT doc_id, {_score_sql("r", 12.0)} AS rhetoric FROM (SELECT *, {_patterns_sql(SCALE.rhetoric)} + len(regexp_extract_all(text, '[A-Z][^.!?]*\?\s')) + 2 * len(regexp_extract_all(text, '[A-Z][^.!?]*\?')) AS r
  FROM (SELECT doc_id, text, lower(text) AS l, {_WORDS_SQL} AS words FROM documents WHERE text IS NOT NULL))""")
def rhetoric_scores(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("doc_id", scoring.rhetoric_score(F.col("text"), T.word_count(F.col("text")), SCALE.rhetoric).alias("rhetoric"))


@query(f"""
WITH c AS (SELECT passage_id, max_by(overall_score, created_at) AS cached FROM swi_scores WHERE overall_score IS NOT NULL GROUP BY passage_id HAVING count(*) = 1),
p AS (SELECT id, min(text) AS text FROM passages GROUP BY id HAVING min(text) IS NOT NULL),
k AS (SELECT sha256('v1:' || text) AS h, min(cached) AS cached FROM p JOIN c ON passage_id = id WHERE id < 'jx-l' GROUP BY 1)
SELECT p.id, coalesce(k.cached, s.overall) AS overall, CASE WHEN k.cached IS NULL THEN 'rules' ELSE 'cache' END AS engine
FROM p LEFT JOIN k ON k.h = sha256('v1:' || p.text) JOIN ({scored_sql("(SELECT id, min(text) AS text FROM passages GROUP BY id)", "id")}) s ON s.id = p.id""")
def score_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """Scores from a cache where it has the text, else by rules. The cache holds passages scored once, of ids up to jx-l."""
    p = read(spark, d, "passages", "id", "text").groupBy("id").agg(F.min("text").alias("text")).where("text is not null")
    once = read(spark, d, "swi_scores", "passage_id", "overall_score").where("overall_score is not null").groupBy("passage_id").agg(F.max("overall_score").alias("overall"), F.count("*").alias("n")).where("n = 1")
    held = p.where("id < 'jx-l'").join(once, F.col("id") == F.col("passage_id")).groupBy(scoring.cache_key(F.col("text"), "v1").alias("cache_key")).agg(F.min("overall").alias("overall"))
    return scoring.dispatched(p, held.withColumn("created_at", F.lit(None).cast("timestamp")), SCALE, "v1")


@query(f"""
WITH g AS (SELECT doc_id, source, title, n FROM (SELECT doc_id, source, title, count(*) OVER (PARTITION BY title) AS n, count(CASE WHEN text IS NULL OR trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g')) = '' OR length(text) > 50000 THEN 1 END) OVER (PARTITION BY title) AS bad FROM documents WHERE title IS NOT NULL) WHERE n BETWEEN 2 AND 5 AND bad = 0)
SELECT title, doc_id, overall, label, row_number() OVER (PARTITION BY title ORDER BY overall DESC, doc_id) AS place, max(overall) OVER (PARTITION BY title) - overall AS behind FROM g JOIN ({_SCORED}) s USING (doc_id)""")
def compared_texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents of one title, where there are two to five, side by side."""
    docs = read(spark, d, "documents", "doc_id", "title", "text").where("title is not null")
    return scoring.compared(docs, SCALE, "title", "doc_id")


@query(f"""
SELECT title_stem, words, overall, label, array_to_string(list_transform(list_sort([{", ".join(f"{{n: '{n}', s: {n}}}" for n in _NAMES)}]), lambda r: r.n || '=' || r.s), ',') AS dims,
  CASE WHEN words < 200 THEN 'This text is only ' || words || ' words; at least 200 are advised.' END AS advisory
FROM (SELECT id AS title_stem, * EXCLUDE (id) FROM ({scored_sql("(SELECT id, min(text) AS text FROM passages WHERE source_type = 'letter' GROUP BY id)", "id")})) WHERE trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g')) <> ''""")
def whole_text_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every letter as one file is scored: name, words, score, dimensions by name, a note on short texts; blank ones are left out."""
    p = read(spark, d, "passages", "id", "source_type", "text").where("source_type = 'letter'").groupBy("id").agg(F.min("text").alias("text")).where(scoring.valid_request(F.col("text"), 10**9))
    s = scoring.with_scores(p, SCALE)
    dims = F.concat_ws(",", *(F.concat(F.lit(f"{n}="), F.col(n).cast("string")) for n in sorted(_NAMES)))
    return s.select(F.col("id").alias("title_stem"), "words", "overall", "label", dims.alias("dims"), scoring.advisory(F.col("words")).alias("advisory"))


@query("""
SELECT doc_id, source, CASE WHEN starts_with(source, 'archive') THEN 'archive' WHEN regexp_matches(coalesce(title, ''), '^(Of|On) ') THEN 'essay' WHEN regexp_matches(coalesce(title, ''), '^To ') THEN 'letter'
  WHEN starts_with(source, 'forum') OR starts_with(source, 'reader') THEN 'comment' ELSE 'other' END AS kind FROM documents""")
def classify_first_match(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents", "doc_id", "source", "title")
    title = F.coalesce("title", F.lit(""))
    rules = [(F.col("source").startswith("archive"), "archive"), (title.rlike("^(Of|On) "), "essay"), (title.rlike("^To "), "letter"), (F.col("source").startswith("forum") | F.col("source").startswith("reader"), "comment")]
    return docs.select("doc_id", "source", T.first_match(rules, "other").alias("kind"))


_GOLDEN = scored_sql("golden_set", "id, bucket, expected_min, expected_max, expected_counter")
_STANCES = ((r"\b(idleness|covetousness)\b",), (r"\b(pride|vanity|unbelief)\b",))
_CHECKED = f"""
SELECT id, bucket, overall, list_concat(
  CASE WHEN overall < expected_min OR overall > expected_max THEN ['score ' || overall || ' outside [' || expected_min || ', ' || expected_max || ']'] ELSE [] END,
  list_transform(list_sort(list_filter(map_entries(coalesce(expected_counter, MAP {{}})), lambda e: e.value IS DISTINCT FROM coalesce(stances[e.key], 'none'))), lambda e: e.key || ': expected ' || coalesce(e.value, 'none') || ', found ' || coalesce(stances[e.key], 'none'))) AS reasons
FROM (SELECT *, MAP {{'dim-0': CAST(least({_patterns_sql(_STANCES[0])}, 9) AS VARCHAR), 'dim-1': CAST(least({_patterns_sql(_STANCES[1])}, 9) AS VARCHAR)}} AS stances FROM ({_GOLDEN}))"""


def _golden(spark: SparkSession, d: str) -> DataFrame:
    g = read(spark, d, "golden_set", "id", "bucket", "text", "expected_min", "expected_max", "expected_counter").where("text is not null")
    low = F.lower("text")
    stances = F.create_map(*(x for k, p in enumerate(_STANCES) for x in (F.lit(f"dim-{k}"), scoring.stance(low, p))))
    return scoring.golden_check(scoring.with_scores(g, SCALE).withColumn("stances", stances))


@query(f"SELECT id, bucket, overall, len(reasons) = 0 AS passed, array_to_string(reasons, '; ') AS reasons FROM ({_CHECKED})")
def golden_checks(spark: SparkSession, d: str) -> DataFrame:
    """Held-out items scored and held against the range and the stances expected of them."""
    return _golden(spark, d).select("id", "bucket", "overall", "passed", F.array_join("reasons", "; ").alias("reasons"))


@query(f"SELECT bucket, count(CASE WHEN len(reasons) = 0 THEN 1 END) AS passed, count(CASE WHEN len(reasons) > 0 THEN 1 END) AS failed FROM ({_CHECKED}) GROUP BY bucket")
def golden_by_bucket(spark: SparkSession, d: str) -> DataFrame:
    return _golden(spark, d).groupBy("bucket").agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))


@query(f"""
WITH f AS (SELECT id, expected_min AS low, expected_max AS high, hash_free % 2 = 0 AS penalised, CASE WHEN hash_free % 3 = 0 THEN 'none' END AS label_wanted FROM (SELECT *, CAST(substr(id, 4, 3) AS INT) AS hash_free FROM golden_set)),
s AS (SELECT * FROM ({scored_sql("(SELECT id, text FROM golden_set WHERE CAST(substr(id, 4, 3) AS INT) % 10 <> 9)", "id")})),
j AS (SELECT f.id, f.low, f.high, f.penalised, f.label_wanted, s.* EXCLUDE (id) FROM f LEFT JOIN s ON s.id = f.id)
SELECT id, CASE WHEN overall IS NULL THEN 'SKIP' WHEN failures = '' THEN 'PASS' ELSE 'FAIL' END AS status, failures FROM (SELECT id, overall, array_to_string(list_filter([
  CASE WHEN overall < low OR overall > high THEN 'overall ' || overall || ' not in [' || low || ', ' || high || ']' END,
  CASE WHEN grace < 0 OR grace > 60 THEN 'grace ' || grace || ' not in [0, 60]' END,
  CASE WHEN penalised AND penalty_applied = 0 THEN 'expected a penalty but none applied' WHEN NOT penalised AND penalty_applied > 0 THEN 'unexpected penalty applied' END,
  CASE WHEN label_wanted <> label THEN 'label ' || label || ' is not ' || label_wanted END], lambda x: x IS NOT NULL), '; ') AS failures FROM j)""")
def fixture_checks(spark: SparkSession, d: str) -> DataFrame:
    """Fixtures made of the held-out items: range, bounds of one dimension, penalty, label; a tenth of them has no text."""
    g = read(spark, d, "golden_set", "id", "text", "expected_min", "expected_max").withColumn("n", F.substring("id", 4, 3).cast("int"))
    dims = F.create_map(F.lit("grace"), F.struct(F.lit(0).alias("low"), F.lit(60).alias("high")))
    fixtures = g.select("id", F.col("expected_min").alias("low"), F.col("expected_max").alias("high"), dims.alias("dims"), (F.col("n") % 2 == 0).alias("penalised"), F.when(F.col("n") % 3 == 0, "none").alias("label"))
    return scoring.fixture_check(scoring.with_scores(g.where("n % 10 <> 9").select("id", "text"), SCALE), fixtures, SCALE)


@query("""
WITH q AS (SELECT id, trim(substr(text, 10, 25)) AS quote FROM golden_set WHERE text IS NOT NULL), d AS (SELECT id, CASE WHEN CAST(substr(id, 4, 3) AS INT) % 2 = 0 THEN upper(text) ELSE substr(text, 40) END AS text FROM golden_set WHERE text IS NOT NULL)
SELECT id, quote, strpos(lower(text), lower(quote)) - 1 AS "offset" FROM q JOIN d USING (id) WHERE quote <> '' AND strpos(lower(text), lower(quote)) > 0""")
def located_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Quotations and where they stand in their texts, of which half are cut so that some quotations are gone."""
    g = read(spark, d, "golden_set", "id", "text").where("text is not null")
    texts = g.select("id", F.when(F.substring("id", 4, 3).cast("int") % 2 == 0, F.upper("text")).otherwise(F.expr("substr(text, 40)")).alias("text"))
    return scoring.located(g.select("id", F.trim(F.substring("text", 10, 25)).alias("quote")), texts, "id")
