"""Sections by type, hidden results, abstract recovery, extraction quality.

Sections come as rows (paper_id, pos, header, content); every strategy returns (paper_id, type, text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.entities import statistical
from lectern.functions.text import contains_any, first_case, header, sentences, strip

# Header words of each section type, in order; the first type that matches wins.
NARROW = (
    ("introduction", ("intro", "background", "overview", "motivation", "related work")),
    ("methods", ("method", "material", "data", "analysis", "participant", "measure", "procedure", "experimental", "study design", "approach")),
    ("results", ("result", "finding", "outcome", "evaluation", "experiment", "performance", "analysis results")),
    ("discussion", ("discuss", "limitation", "implication", "interpretation", "comparison", "future work")),
    ("conclusion", ("conclu", "summary", "contribution", "concluding", "final")),
)
WIDE = (
    ("introduction", ("intro", "background", "overview", "motivation", "objectives", "aims", "purpose", "rationale", "significance", "problem statement")),
    (
        "methods",
        (
            "method", "methodology", "materials", "procedure", "study design", "participants", "data collection", "measures", "statistical analysis",
            "protocol",
            "experimental design", "sample", "intervention", "study population", "patient population", "participant recruitment", "enrollment", "subjects",
            "inclusion criteria", "exclusion criteria", "eligibility", "data sources", "measurements", "assessment", "procedures", "interventions",
            "statistical methods", "sample size calculation", "power analysis",
        ),
    ),
    (
        "results",
        (
            "result", "finding", "outcome", "analysis", "baseline characteristics", "primary outcome", "secondary outcome", "efficacy", "effectiveness",
            "patient characteristics", "demographic", "clinical characteristics", "safety", "adverse events", "side effects",
        ),
    ),
    (
        "discussion",
        (
            "discuss", "interpretation", "implication", "limitation", "strength", "weakness", "clinical significance", "comparison", "clinical implication",
            "future direction", "study limitation",
        ),
    ),
    ("conclusion", ("conclu", "summary", "future", "recommendation", "take-home", "final thoughts", "contribution", "key findings", "clinical recommendation")),
)
NUMBERED = (
    (r"^[0-9]+\.?\s*introduction", "introduction"), (r"^[0-9]+\.?\s*(method|approach|material)", "methods"),
    (r"^[0-9]+\.?\s*(result|experiment)", "results"), (r"^[0-9]+\.?\s*discussion", "discussion"), (r"^[0-9]+\.?\s*conclusion", "conclusion")
)


def section_type(name: Column, table=NARROW) -> Column:
    return first_case([(contains_any(name, words), kind) for kind, words in table])


def _merged(rows: DataFrame) -> DataFrame:
    """Sections of a type joined by a blank line, in their order."""
    parts = F.array_sort(F.collect_list(F.struct("pos", "content")))
    return (
        rows.where("type IS NOT NULL AND content <> ''").groupBy("paper_id", "type")
            .agg(F.array_join(F.transform(parts, lambda x: x["content"]), "\n\n").alias("text"))
    )


def sections_optimized(rows: DataFrame) -> DataFrame:
    return _merged(rows.withColumn("type", section_type(strip(F.lower("header")))))


def sections_baseline(rows: DataFrame) -> DataFrame:
    """Case counts, and the first section of a type is the only one."""
    typed = rows.withColumn("type", section_type(strip(F.col("header")))).where("type IS NOT NULL")
    return typed.groupBy("paper_id", "type").agg(F.min_by("content", "pos").alias("text"))


def sections_experimental(rows: DataFrame) -> DataFrame:
    """Words, then numbered headers, then place: a first section is an introduction, a last one may conclude."""
    low, w = strip(F.lower("header")), W.partitionBy("paper_id")
    placed = rows.withColumn("i", F.row_number().over(w.orderBy("pos"))).withColumn("n", F.count("*").over(w))
    numbered = [(low.rlike(p), kind) for p, kind in NUMBERED]
    place = [
        ((F.col("i") == 1) & (F.length(low) > 3), "introduction"),
        ((F.col("i") == F.col("n")) & (low.contains("future") | low.contains("summary")), "conclusion")
    ]
    return _merged(placed.withColumn("type", F.coalesce(section_type(low), first_case([*numbered, *place]))))


def sections_wide(rows: DataFrame) -> DataFrame:
    return _merged(rows.withColumn("type", F.coalesce(section_type(header(F.col("header")), WIDE), F.lit("other"))))


STRATEGIES = {"baseline": sections_baseline, "v5_optimized": sections_optimized, "experimental": sections_experimental}


def compare(rows: DataFrame) -> DataFrame:
    """(strategy, type, papers, chars)."""
    out = None
    for name, f in STRATEGIES.items():
        one = f(rows).groupBy("type").agg(F.count("*").alias("papers"), F.sum(F.length("text")).alias("chars")).withColumn("strategy", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def as_map(sections: DataFrame) -> DataFrame:
    """(paper_id, sections): one map type -> text a paper."""
    return sections.groupBy("paper_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "text")))).alias("sections"))


def hidden_results(sections: DataFrame) -> DataFrame:
    """(paper_id, hidden) of papers without results of over 100 characters: other sections with statistical content."""
    w = W.partitionBy("paper_id")
    known = sections.withColumn("known", F.max(((F.col("type") == "results") & (F.length("text") > 100)).cast("int")).over(w))
    rows = known.where((F.col("known") == 0) & ~F.col("type").isin("methods", "introduction") & statistical(F.col("text")))
    return (
        rows.groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("type", "text"))), lambda x: x["text"]), "\n\n").alias("hidden"))
    )


# Fixed values of abstract recovery.
METHOD_WORDS = ("randomly assigned", "randomized", "we conducted", "participants", "primary outcome", "trial", "this study", "we investigated", "we examined")
INTRO_WORDS = ("objective", "methods", "results", "conclusion", "background", "aim", "findings", "significance")
TITLE_PHRASES = ("this study", "we investigated", "objective", "we examined")


def _count(text: Column, words: tuple[str, ...]) -> Column:
    return sum((text.contains(w).cast("int") for w in words), F.lit(0))


def abstract_recovered(s: Column, title: Column) -> Column:
    """From the methods, else the introduction, else a section named like the title, else made of sentences. s: map type -> text."""
    methods, intro = s["methods"], s["introduction"]
    first = F.when(methods.contains("\n\n"), F.substring_index(methods, "\n\n", 1)).otherwise(F.substring(methods, 1, 1500))
    a = F.when(_count(F.lower(first), METHOD_WORDS) >= 2, strip(first))
    paragraphs = F.array_join(F.slice(F.split(intro, "\n\n"), 1, 3), "\n\n")
    b = F.when((F.length(intro) >= 500) & (_count(F.lower(F.substring(intro, 1, 2000)), INTRO_WORDS) >= 3), strip(F.substring(paragraphs, 1, 1500)))
    words = F.regexp_extract_all(F.lower(title), F.lit(r"(?U)\b\w{4,}\b"), F.lit(0))
    like = F.filter(
        F.map_entries(s),
        lambda e: (F.size(F.filter(words, lambda w: F.lower(e["key"]).contains(w))) >= 2) & contains_any(F.lower(F.substring(e["value"], 1, 2000)), TITLE_PHRASES)
    )
    c = strip(F.substring(F.get(like, F.lit(0))["value"], 1, 1500))
    pick = lambda text, w: F.get(F.filter(F.slice(sentences(text), 1, 3), lambda x: contains_any(F.lower(x), w)), F.lit(0))
    made = F.array_compact(
        F.array(
            pick(methods, ("participants", "assigned", "conducted", "we")), pick(s["results"], ("significant", "found", "demonstrated", "showed")),
            F.get(sentences(s["conclusion"]), F.lit(0))
        )
    )
    d = F.when(F.size(made) >= 2, F.concat(F.lit("[Abstract synthesized from paper sections] "), F.array_join(made, " ")))
    return F.coalesce(a, b, c, d)


def total_chars(s: Column) -> Column:
    return F.aggregate(F.map_values(s), F.lit(0), lambda acc, x: acc + F.length(x))


def completeness(abstract: Column, s: Column) -> Column:
    """0..100: abstract 20, key sections 60, length 20."""
    n = F.coalesce(F.length(abstract), F.lit(0))
    key = sum((F.when(F.length(s[k]) > 200, p).otherwise(0) for k, p in (("introduction", 15), ("methods", 20), ("results", 15), ("discussion", 10))), F.lit(0))
    size = total_chars(s)
    return first_case([(n > 100, 20), (n > 50, 10)], 0) + key + first_case([(size > 10000, 20), (size > 5000, 15), (size > 2000, 10), (size > 1000, 5)], 0)


def extraction_quality(abstract: Column, s: Column) -> Column:
    """0..1."""
    key = sum((F.when(F.length(s[k]) > 100, 0.125).otherwise(0.0) for k in ("introduction", "methods", "results", "discussion")), F.lit(0.0))
    size = total_chars(s)
    return F.least(
        F.lit(1.0),
        F.when(F.coalesce(abstract, F.lit("")) != "", 0.3).otherwise(0.0) + key
        + first_case([(size > 10000, 0.2), (size > 5000, 0.1), (size > 2000, 0.05)], 0.0)
    )


# Other words for a section's name.
ALIASES = {
    "method": "methods", "methodology": "methods", "result": "results", "finding": "results", "conclusion": "conclusions", "discussion": "discussion",
    "discuss": "discussion"
}


def header_parts(name: Column) -> Column:
    """The sections that a header names: its parts around " and ", aliases resolved."""
    return F.transform(F.split(F.lower(name), " and "), lambda x: F.coalesce(*(F.when(x == k, F.lit(v)) for k, v in ALIASES.items()), x))


def quality_metrics(abstract: Column, s: Column, n_entities: Column) -> Column:
    """struct of what an extraction holds: lengths, sections, entities, whether it needs a retry, and its completeness."""
    n = F.coalesce(F.length(abstract), F.lit(0))
    names = ("introduction", "methods", "results", "discussion", "conclusion")
    size = F.size(s)
    return F.struct(
        (n > 100).alias("has_abstract"), n.alias("abstract_length"), size.alias("section_count"),
        *(F.map_contains_key(s, F.lit(k)).alias(f"has_{k}") for k in names),
        total_chars(s).alias("total_content_length"), n_entities.alias("entity_richness"), ((size < 4) | (n < 100)).alias("needs_retry"),
        completeness(abstract, s).alias("extraction_completeness"),
    )


def post_process(papers: DataFrame, rows: DataFrame) -> DataFrame:
    """(paper_id, abstract, sections, hidden, metrics, score) of papers (paper_id, title, abstract) from their section rows.

    Sections are aggregated by the wide table, hidden results go behind the results, a missing abstract is recovered, and
    the outcome is measured. Papers without sections keep their abstract.
    """
    typed = sections_wide(rows)
    hidden = hidden_results(typed)
    maps = as_map(typed).join(hidden, "paper_id", "left")
    found = F.coalesce(F.col("hidden"), F.lit("")) != ""
    results = F.concat_ws("\n\n", F.col("sections")["results"], "hidden")
    merged = (
        F.when(found, F.map_concat(F.map_filter("sections", lambda k, v: k != "results"), F.create_map(F.lit("results"), results))).otherwise(F.col("sections"))
    )
    both = papers.join(maps.select("paper_id", merged.alias("sections"), "hidden"), "paper_id", "left")
    both = both.withColumn("sections", F.coalesce("sections", F.create_map().cast("map<string,string>")))
    abstract = F.coalesce(F.when(F.length("abstract") > 0, F.col("abstract")), abstract_recovered(F.col("sections"), F.col("title")), F.lit(""))
    out = both.withColumn("abstract", abstract)
    return out.select(
        "paper_id", "abstract", "sections", "hidden", quality_metrics(F.col("abstract"), F.col("sections"), F.lit(0)).alias("metrics"),
        extraction_quality(F.col("abstract"), F.col("sections")).alias("score")
    )


def get_sections(s: DataFrame, names: list[str]) -> DataFrame:
    """(paper_id, type, text) of the types asked for; abstract-like names may be given in any case."""
    return s.where(F.col("type").isin([n.lower() for n in names]))


# Which sections a question asks for.
ASKS = (
    ("methods", ("how", "method", "sample", "design", "measure")), ("results", ("result", "effect", "outcome", "find")),
    ("discussion", ("why", "limit", "mean", "implic")), ("introduction", ("what", "background", "aim"))
)


def smart_get(s: DataFrame, question: str, k: int = 10) -> DataFrame:
    """(paper_id, type, text, hits): sections of the types that a question asks for (all if none), by how many of its words
    of four letters and more they hold; the k best."""
    low = question.lower()
    wanted = [name for name, words in ASKS if any(w in low for w in words)]
    words = sorted({w for w in low.replace("?", " ").split() if len(w) >= 4})
    hits = sum((F.lower("text").contains(w).cast("int") for w in words), F.lit(0))
    rows = get_sections(s, wanted) if wanted else s
    return rows.withColumn("hits", hits).where("hits > 0").orderBy(F.desc("hits"), "paper_id", "type").limit(k)


# Fixed values of the tiered extractor: the least similarity of a fuzzy match, and how many types end the first and second tier.
FUZZY, FIRST_EXIT, SECOND_EXIT = 0.75, 5, 4
CANONICAL = tuple(kind for kind, _ in NARROW)


def fuzzy_type(name: Column) -> Column:
    """The first type whose name is at least FUZZY similar: 1 less the edit distance as a share of the longer one."""
    alike = lambda k: 1 - F.levenshtein(name, F.lit(k)) / F.greatest(F.length(name), F.lit(len(k))) >= FUZZY
    return first_case([(alike(k), k) for k in CANONICAL])


def sections_tiered(rows: DataFrame) -> DataFrame:
    """(paper_id, pos, type, tier): headers that are a type's name, then those that hold one of its words, then similar ones.

    A tier is tried only for papers in which those before found fewer types than their exit asks for.
    """
    low, name = strip(F.lower("header")), header(F.col("header"))
    exact = first_case([(low == k, k) for k in CANONICAL])
    each = F.collect_set
    one = rows.select("paper_id", "pos", exact.alias("t1"), section_type(low).alias("t2"), fuzzy_type(name).alias("t3"))
    found = one.groupBy("paper_id").agg(F.size(each("t1")).alias("n1"), F.size(each(F.coalesce("t1", "t2"))).alias("n2"))
    both = one.join(found, "paper_id")
    second = F.when(F.col("n1") < FIRST_EXIT, F.col("t2"))
    third = F.when((F.col("n1") < FIRST_EXIT) & (F.col("n2") < SECOND_EXIT), F.col("t3"))
    tier = first_case([(F.col("t1").isNotNull(), 1), (second.isNotNull(), 2), (third.isNotNull(), 3)])
    out = both.select("paper_id", "pos", F.coalesce("t1", second, third).alias("type"), tier.alias("tier"))
    return out.where("type IS NOT NULL")
