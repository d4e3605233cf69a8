"""Column functions on text. Everything here stays in the JVM, except nfkc(), which is for ingest."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F

# Fixed values -----------------------------------------------------------------------------------------------------
QUERY_STOPWORDS = ["about", "algorithm", "an", "and", "approach", "describe", "explain", "flow", "for", "from", "how", "in", "method", "methods", "of", "on", "paper", "please", "process", "summarize", "summary", "the", "to", "what", "with", "workflow"]
GRAPH_STOPWORDS = ["about", "and", "are", "can", "does", "approach", "approaches", "data", "dataset", "datasets", "for", "from", "framework", "how", "in", "is", "it", "of", "on", "paper", "papers", "please", "show", "summarize", "summary", "the", "this", "to", "what", "which", "with"]
SUMMARY_TERMS = {"abstract": 0.8, "contribution": 0.8, "framework": 1.2, "method": 1.4, "overview": 1.6, "propose": 0.8, "proposed": 0.8}
WORKFLOW_TERMS = {"finally": 0.7, "first": 0.7, "next": 0.7, "overview": 1.4, "process": 1.6, "procedure": 1.4, "step": 1.0, "steps": 1.0, "then": 0.7, "workflow": 1.6}
SUMMARY_CUES = ["总结", "概述", "summary", "summarize", "overview"]
WORKFLOW_CUES = ["流程", "步骤", "过程", "workflow", "process", "procedure", "step"]
REFERENCE_MARKERS = ["proceedings", "transactions", "conference", "journal", "arxiv", "acm", "ieee", "springer", " proc.", " conf.", " pp.", " et al.", " available:", "press.", "trans."]
SECTION_TERMS = {
    "abstract": ["abstract"],
    "related": ["related work", "background", "literature review"],
    "method": ["method", "methods", "methodology", "proposed method", "proposed framework", "framework", "algorithm", "model", "architecture", "approach"],
    "experiment": ["experiment", "experiments", "evaluation", "results", "ablation", "dataset"],
    "conclusion": ["conclusion", "discussion", "limitations", "future work"],
    "references": ["references", "bibliography"],
}
PAPER_LEVEL_CUES = ["哪篇论文", "哪些论文", "相关论文", "提出了某方法", "which paper", "which papers", "related papers"]
ABSTRACT_CUES = ["总结", "对比", "共同问题", "研究脉络", "有哪些方向", "这些论文", "summarize", "compare", "common problem", "research trend"]
ENTITY_INTENTS = {
    "contribution": (4.5, ["contribution", "novelty", "贡献", "创新", "提出"]),
    "finding": (4.5, ["finding", "conclusion", "ablation", "发现", "结论", "实验结论"]),
    "futurework": (4.0, ["future", "future work", "未来", "展望", "后续"]),
    "problem": (4.0, ["problem", "challenge", "scenario", "setting", "问题", "挑战", "场景"]),
    "scenario": (4.0, ["problem", "challenge", "scenario", "setting", "问题", "挑战", "场景"]),
    "module": (3.0, ["component", "module", "architecture", "组件", "模块", "结构", "架构"]),
    "limitation": (4.0, ["limitation", "weakness", "局限", "缺点", "不足"]),
    "dataset": (3.0, ["dataset", "data", "数据集", "数据"]),
    "method": (2.0, ["method", "model", "framework", "方法", "模型", "框架"]),
    "model": (2.0, ["method", "model", "framework", "方法", "模型", "框架"]),
    "metric": (3.0, ["metric", "result", "指标", "结果"]),
}
PREDICATE_INTENTS = {
    "proposes": ["propose", "proposed", "introduce", "introduced", "contribution", "novel", "提出", "介绍", "贡献", "创新"],
    "uses": ["use", "uses", "employ", "employs", "framework", "method", "使用", "采用", "方法", "框架"],
    "has_component": ["component", "module", "architecture", "layer", "block", "组件", "模块", "结构", "架构"],
    "evaluated_on": ["evaluate", "evaluated", "experiment", "dataset", "benchmark", "实验", "评测", "数据集"],
    "evaluated_by": ["metric", "accuracy", "auc", "f1", "measure", "指标", "评价", "衡量"],
    "reports_result": ["result", "performance", "achieve", "outperform", "结果", "性能", "达到"],
    "has_finding": ["finding", "conclusion", "ablation", "observation", "结论", "发现", "实验结论", "消融"],
    "solves": ["solve", "solves", "address", "challenge", "problem", "解决", "问题", "挑战"],
    "addresses_scenario": ["scenario", "setting", "application", "domain", "场景", "应用", "领域"],
    "improves_on": ["improve", "improves", "better", "outperform", "改进", "提升", "优于"],
    "improves": ["improve", "improves", "better", "改进", "提升"],
    "compares_with": ["compare", "comparison", "baseline", "versus", "对比", "比较", "基线"],
    "has_limitation": ["limitation", "weakness", "drawback", "failure", "局限", "缺点", "不足"],
    "has_future_work": ["future", "future work", "extension", "未来", "展望", "后续"],
    "similar_to": ["similar", "related", "相似", "相关"],
    "defines": ["define", "definition", "定义"],
    "has_property": ["property", "invariant", "characteristic", "性质", "特性"],
    "formulates_as": ["formulate", "formulation", "objective", "建模", "表述", "目标函数"],
    "outputs": ["output", "predict", "score", "输出", "预测", "得分"],
    "supports": ["support", "evidence", "支持", "证明"],
    "extends": ["extend", "extends", "扩展"],
    "mentions": ["mention", "mentions", "提到"],
    "reports_metric": ["metric", "result", "accuracy", "auc", "指标", "结果", "性能"],
    "addresses_problem": ["problem", "challenge", "motivation", "解决", "问题", "挑战", "动机"],
}
STRONG_PREDICATES = ["proposes", "evaluated_on", "evaluated_by", "reports_result", "has_finding", "solves", "has_limitation", "has_future_work", "reports_metric"]
PROCEDURAL_CUES, PROCEDURAL_PATTERN = ["如何", "步骤", "流程", "过程"], r"\b(how to|steps?|procedure|pipeline|workflow|algorithm)\b"
SURVEY_CUES, SURVEY_PATTERN = ["综述", "全局", "整体", "趋势"], r"\b(overview|survey|landscape|trend|broadly|overall)\b"
MULTI_HOP_CUES, MULTI_HOP_PATTERN = ["以及", "并且", "为什么", "区别", "关系", "对比"], r"\b(and|versus|vs\.?|compare|why|relationship|difference)\b"
QUERY_KINDS = {"fact": "fact", "factual": "fact", "multi-hop": "multi-hop", "multihop": "multi-hop", "abstract": "abstract", "global": "abstract", "procedural": "procedural", "procedure": "procedural", "method": "procedural"}
ABSTRACT_KEYWORDS = ["global context", "research landscape", "related methods"]
PROCEDURAL_KEYWORDS = ["steps", "method", "input", "output"]
MODES = {"hybrid": "hybrid", "chunk": "hybrid", "chunks": "hybrid", "graph": "graph", "kg": "graph", "graph-assisted": "graph", "community": "archrag-lite", "communities": "archrag-lite", "archrag": "archrag", "archrag-lite": "archrag-lite", "archrag-gated": "archrag-gated", "community-gated": "archrag-gated"}
ANCHOR_WEIGHT = 8.0
# -------------------------------------------------------------------------------------------------------------------


def nfkc(text: Column) -> Column:
    """NFKC form, in Arrow batches; for ingest, once."""

    @F.pandas_udf("string")
    def form(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFKC")

    return form(text)


def collapse(text: Column) -> Column:
    """Runs of white space (Unicode's) to one space; trimmed."""
    return F.btrim(F.regexp_replace(text, r"(?U) \s+|[\s&&[^ ]]\s*", " "))  # a space that stands alone needs no replacement


def normalised(text: Column) -> Column:
    """NFKC form with runs of white space as one space; null is empty. A Python worker's: for ingest, and for the few questions; it gets only texts with
    characters beyond ASCII and the letters of Latin-1, which have no other form."""
    return collapse(F.coalesce(nfkc(F.when(text.rlike(r"[^\x00-\x7F\u00C0-\u00FF]"), text)), text, F.lit("")))


def search_text(columns: list[str]) -> Column:
    """What keywords are sought in, lower-cased: the chunk's source, path, page and number, where it has them, and its text."""
    about = [c for c in ("source", "source_path", "page") if c in columns] + [c for c in ("chunk_id", "doc_id") if c in columns][:1]
    return F.lower(F.concat(normalised(F.concat_ws(" ", *about)), F.lit(" "), normalised(F.col("text"))))


def any_of(text: Column, cues: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, cues)), lambda c: F.contains(text, c))


def term_count(text: Column, term: Column) -> Column:
    """Occurrences that don't overlap."""
    return ((F.length(text) - F.length(F.replace(text, term))) / F.length(term)).cast("bigint")


def anchors(query: Column) -> Column:
    """Query words of three letters or more that are no stop words, each with its form without hyphens."""
    raw = F.regexp_extract_all(F.lower(collapse(query)), F.lit("([a-z][a-z0-9_-]*)"))
    words = F.filter(F.transform(raw, lambda w: F.btrim(w, F.lit("-_"))), lambda w: (F.length(w) >= 3) & ~w.isin(QUERY_STOPWORDS))

    def forms(w):
        bare = F.translate(w, "-_", "")
        return F.array_compact(F.array(w, F.when(bare != w, bare), F.when(bare == "migraph", "mi-graph")))

    return F.array_distinct(F.flatten(F.transform(words, forms)))


def query_terms(query: Column) -> Column:
    """array<struct<term, weight, anchor>>: anchors, and the words of the intents that the query shows (an anchor wins)."""
    intents = F.expr("array(" + ", ".join(f"named_struct('term', '{t}', 's', {SUMMARY_TERMS.get(t, 'NULL')}::double, 'f', {WORKFLOW_TERMS.get(t, 'NULL')}::double)" for t in {**SUMMARY_TERMS, **WORKFLOW_TERMS}) + ")")
    struct = lambda t, w, a: F.struct(t.alias("term"), w.cast("double").alias("weight"), F.lit(a).alias("anchor"))

    def build(x: Column) -> Column:
        more = F.transform(intents, lambda i: struct(i.term, F.greatest(F.when(x.s, i.s), F.when(x.w, i.f)), False))
        more = F.filter(more, lambda t: t.weight.isNotNull() & ~F.array_contains(x.found, t.term))
        return F.concat(F.transform(x.found, lambda t: struct(t, F.lit(ANCHOR_WEIGHT), True)), F.when(F.size(x.found) > 0, more).otherwise(F.slice(more, 1, 0)))

    lowered = F.lower(collapse(query))
    # An array of one, so that its fields are worked out once.
    return F.transform(F.array(F.struct(anchors(query).alias("found"), any_of(lowered, SUMMARY_CUES).alias("s"), any_of(lowered, WORKFLOW_CUES).alias("w"))), build)[0]


def keyword_score(text: str, terms: str) -> Column:
    """Sum over terms of w * (1 + ln(1 + tf)), tf at most 3 but 1 for an anchor; half or all of w more for an early first place.
    text and terms are column names."""
    early = "contains(left({x}, {n} + length(t.term)), t.term)"  # the place itself isn't needed, and looking for it in the whole text is dear
    return F.expr(
        "aggregate({t}, 0D, (acc, t) -> acc + if(NOT contains({x}, t.term), 0D, t.weight * (1 + ln(1 + if(t.anchor, 1, least(3, (length({x}) - length(replace({x}, t.term))) / length(t.term)))))".format(t=terms, x=text)
        + f" + if({early.format(x=text, n=119)}, t.weight, if({early.format(x=text, n=499)}, 0.5D * t.weight, 0D))))"
    )


def reference_like(text: Column) -> Column:
    """Looks like a list of references: so headed, or three years and two markers of publications."""
    t = F.lower(collapse(text))
    marks = sum((F.contains(t, F.lit(m)).cast("int") for m in REFERENCE_MARKERS), F.lit(0))
    return F.contains(F.substring(t, 1, 500), F.lit("references")) | ((F.regexp_count(t, F.lit(r"\b(?:19|20)\d{2}\b")) >= 3) & (marks >= 2))


def section_title(text: Column) -> Column:
    """The first of the first 20 lines, of 120 characters at most, that is or begins with a section's name, numbering aside; '' if none."""
    names = sorted({t for terms in SECTION_TERMS.values() for t in terms})
    lines = F.transform(F.slice(F.split(text, "\n"), 1, 20), lambda x: F.btrim(F.regexp_replace(x, r"\s+", " "), F.lit(" .\t")))

    def heads(line):
        bare = F.regexp_replace(F.lower(line), r"^(?:\d+(?:\.\d+)*|[ivxlcdm]+)\s*[\).:-]?\s+", "")
        return (line != "") & (F.length(line) <= 120) & F.exists(F.array(*map(F.lit, names)), lambda n: (bare == n) | F.startswith(bare, F.concat(n, F.lit(" "))))

    return F.coalesce(F.get(F.filter(lines, heads), F.lit(0)), F.lit(""))


def section_type(title: Column, text: Column, page: Column, chunk_id: Column) -> Column:
    """The first type one of whose names stands in the title or the first 700 characters."""
    t = F.lower(F.concat(title, F.lit(" "), F.substring(text, 1, 700)))
    out = F
    for kind, names in SECTION_TERMS.items():
        out = out.when(any_of(t, names), F.lit(kind))
    return out.when((page == 1) & (chunk_id <= 2), F.lit("abstract")).otherwise(F.lit("body"))


def canonical_name(name: Column) -> Column:
    """Lower case, one space between words, a trailing (ACRONYM) dropped."""
    bare = F.regexp_replace(collapse(name), r"\s*\([A-Za-z0-9][A-Za-z0-9_-]{1,20}\)\s*$", "")
    return F.lower(F.btrim(F.regexp_replace(bare, r"[\s_-]+", " ")))


def slug(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(F.btrim(text)), r"[^a-z0-9]+", "_"), F.lit("_"))


def path_stem(path: Column) -> Column:
    """Base name without its last suffix, lower-cased."""
    return F.regexp_replace(F.regexp_replace(F.lower(path), r"^.*[/\\]", ""), r"(.)\.[^.]+$", "$1")


def stable_chunk_id(source: Column, page: Column, start: Column, text: Column) -> Column:
    digest = F.substring(F.sha1(collapse(text)), 1, 12)
    return F.substring(F.sha1(F.concat(source, F.lit("|p"), page.cast("string"), F.lit("|s"), start.cast("string"), F.lit("|"), digest)), 1, 16)


def without_thoughts(answer: Column) -> Column:
    return F.btrim(F.regexp_replace(answer, r"(?is)<think>.*?</think>", ""))


def has_citation(answer: Column) -> Column:
    return answer.rlike(r"\[S\d+\]")


def safe_int(text: Column) -> Column:
    return F.coalesce(text.try_cast("bigint"), F.lit(0).cast("bigint"))


def paper_query_type(query: Column) -> Column:
    q = F.lower(collapse(query))
    return F.when(any_of(q, PAPER_LEVEL_CUES), "paper_level").when(any_of(q, ABSTRACT_CUES), "abstract").otherwise("specific")


def overlap_terms(query: Column, stopwords: list[str] = GRAPH_STOPWORDS) -> Column:
    raw = F.regexp_extract_all(F.lower(collapse(query)), F.lit("([a-z][a-z0-9_-]+)"))
    return F.array_distinct(F.filter(F.transform(raw, lambda w: F.btrim(w, F.lit("-_"))), lambda w: (F.length(w) >= 3) & ~w.isin(stopwords)))


def weighted_overlap(terms: Column, text: Column) -> Column:
    """1 for each term the text holds, 1.5 for terms of six letters or more."""
    return F.aggregate(terms, F.lit(0.0), lambda a, t: a + F.when(F.contains(text, t), F.when(F.length(t) >= 6, 1.5).otherwise(1.0)).otherwise(0.0))


def keyword_relevance(terms: Column, text: Column) -> Column:
    """Share of terms in the text; a term that only matches without regard to case counts half."""
    low = F.lower(text)
    hits = F.aggregate(terms, F.lit(0.0), lambda a, t: a + F.when(F.contains(text, t), 1.0).when(F.contains(low, F.lower(t)), 0.5).otherwise(0.0))
    return F.when(F.size(terms) > 0, hits / F.size(terms)).otherwise(0.0)


# Graph intents -------------------------------------------------------------------------------------------------------


def entity_type_intent(kind: Column, query: Column) -> Column:
    """The bonus of an entity's type where the lower-cased query shows its intent, else 0."""
    out = F.lit(0.0)
    for name, (score, cues) in ENTITY_INTENTS.items():
        out = F.when((F.lower(kind) == name) & any_of(query, cues), F.lit(score)).otherwise(out)
    return out


def predicate_intent(predicate: Column, query: Column) -> Column:
    """4 for a strong predicate whose intent the lower-cased query shows, 2 for another, else 0."""
    cues = F.create_map(*[x for name, words in PREDICATE_INTENTS.items() for x in (F.lit(name), F.array(*map(F.lit, words)))])
    shown = F.exists(F.coalesce(F.try_element_at(cues, predicate), F.array().cast("array<string>")), lambda c: F.contains(query, c))
    return F.when(shown, F.when(predicate.isin(STRONG_PREDICATES), 4.0).otherwise(2.0)).otherwise(0.0)


# Gated retrieval ------------------------------------------------------------------------------------------------------


def distinct(values: Column) -> Column:
    """Values that are not empty, the first of those that differ in case only."""
    full = F.filter(F.transform(values, lambda x: F.btrim(x)), lambda x: x != "")
    low = F.transform(full, lambda x: F.lower(x))
    return F.filter(full, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def gated_terms(query: Column) -> Column:
    """Latin words of three letters or more and runs of Chinese, of the lower-cased query."""
    q = F.lower(collapse(query))
    latin = F.filter(F.transform(F.regexp_extract_all(q, F.lit("([a-z][a-z0-9_-]+)")), lambda w: F.btrim(w, F.lit("-_"))), lambda w: F.length(w) >= 3)
    return F.array_distinct(F.array_union(latin, F.regexp_extract_all(q, F.lit("([\u4e00-\u9fff]{2,})"))))


def keyword_overlap(terms: Column, searchable: Column) -> Column:
    """weighted_overlap by the number of terms, 1 at most."""
    return F.when(F.size(terms) > 0, F.least(F.lit(1.0), weighted_overlap(terms, searchable) / F.size(terms))).otherwise(0.0)


def section_match(terms: Column, title: Column, kind: Column) -> Column:
    """1 if a term stands in the section's title or type."""
    t = F.lower(F.concat_ws(" ", title, kind))
    return F.when(F.exists(terms, lambda x: F.contains(t, x)), 1.0).otherwise(0.0)


# Query planning -------------------------------------------------------------------------------------------------------


def rerank_terms(query: Column) -> Column:
    """Latin tokens, case kept, or else Chinese bigrams; each once."""
    q = collapse(query)
    latin = F.regexp_extract_all(q, F.lit(r"([A-Za-z0-9][A-Za-z0-9_+\-]+)"))
    runs = F.regexp_extract_all(q, F.lit("([\u4e00-\u9fff]{2,})"))
    bigrams = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return F.array_distinct(F.when(F.size(latin) > 0, latin).otherwise(bigrams))


def query_kind(query: Column) -> Column:
    """procedural, abstract, multi-hop or fact."""
    low = F.lower(query)
    return (
        F.when(low.rlike(PROCEDURAL_PATTERN) | any_of(query, PROCEDURAL_CUES), "procedural")
        .when(low.rlike(SURVEY_PATTERN) | any_of(query, SURVEY_CUES), "abstract")
        .when(low.rlike(MULTI_HOP_PATTERN) | any_of(query, MULTI_HOP_CUES), "multi-hop")
        .otherwise("fact")
    )


def normalized_kind(kind: Column) -> Column:
    """One of the four kinds, fact for what is none."""
    table = F.create_map(*[F.lit(x) for kv in QUERY_KINDS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.replace(F.lower(F.btrim(kind)), F.lit("_"), F.lit("-"))), F.lit("fact"))


def query_entities(query: Column) -> Column:
    """What stands in quotes, and runs of capitalised words; eight at most."""
    quoted = F.regexp_extract_all(query, F.lit('["“](.+?)["”]'))
    named = F.regexp_extract_all(query, F.lit(r"(?<![\p{L}\p{N}_])([A-Z][A-Za-z0-9+_.-]*(?:\s+[A-Z][A-Za-z0-9+_.-]*)*)(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_])"))
    return F.slice(distinct(F.concat(quoted, named)), 1, 8)


def query_keywords(query: Column) -> Column:
    """Latin tokens of three characters or more, then runs of Chinese; twelve at most."""
    return F.slice(distinct(F.concat(F.regexp_extract_all(query, F.lit(r"([A-Za-z0-9][A-Za-z0-9_+\-]{2,})")), F.regexp_extract_all(query, F.lit("([\u4e00-\u9fff]{2,})")))), 1, 12)


def rewritten(query: Column, parsed: Column | None = None) -> Column:
    """struct<original_query, standalone_query, entities, keywords, sub_questions, query_type>. parsed: the same fields (without the first) from a
    model; what is null or empty there is filled by rule."""
    own = F.btrim(query)
    get = (lambda f, kind: parsed[f]) if parsed is not None else (lambda f, kind: F.lit(None).cast(kind))
    texts = "array<string>"
    standalone = F.coalesce(F.nullif(F.btrim(get("standalone_query", "string")), F.lit("")), own)
    kind = normalized_kind(F.coalesce(get("query_type", "string"), query_kind(standalone)))
    listed = lambda f: distinct(F.coalesce(get(f, texts), F.array().cast(texts)))
    or_else = lambda xs, rule: F.when(F.size(xs) > 0, xs).otherwise(rule)
    entities, words, subs = or_else(listed("entities"), query_entities(own)), or_else(listed("keywords"), query_keywords(own)), listed("sub_questions")
    lits = lambda xs: F.array(*map(F.lit, xs))
    words = F.when(kind == "abstract", distinct(F.concat(words, lits(ABSTRACT_KEYWORDS)))).when(kind == "procedural", distinct(F.concat(words, lits(PROCEDURAL_KEYWORDS)))).otherwise(words)
    made = F.array(F.concat(F.lit("What are the key entities and claims in: "), own), F.concat(F.lit("How are those entities or claims connected in: "), own))
    subs = F.when(kind == "multi-hop", F.when(F.size(subs) >= 2, subs).otherwise(distinct(F.concat(subs, made)))).otherwise(or_else(subs, F.array(own)))
    return F.struct(own.alias("original_query"), standalone.alias("standalone_query"), entities.alias("entities"), words.alias("keywords"), F.slice(subs, 1, 4).alias("sub_questions"), kind.alias("query_type"))


def retrieval_query(r: Column) -> Column:
    """The rewritten question as one text to search by."""
    part = lambda head, xs, sep: F.when(F.size(xs) > 0, F.concat(F.lit(head), F.array_join(xs, sep)))
    return F.concat_ws("\n", r["standalone_query"], part("Entities: ", r["entities"], "; "), part("Keywords: ", r["keywords"], "; "), part("Sub-questions: ", r["sub_questions"], " | "))


def retrieval_mode(mode: str) -> str:
    """One of hybrid, graph, archrag-lite, archrag-gated, archrag, for any of its spellings."""
    m = mode.strip().lower().replace("_", "-")
    if m not in MODES:
        raise ValueError(f"retrieval mode must be one of {sorted(set(MODES))}, not {mode!r}")
    return MODES[m]


# Model output ---------------------------------------------------------------------------------------------------------


def json_object(text: Column) -> Column:
    """The outermost {...} of a model's answer, fences aside; null without one."""
    bare = F.regexp_replace(F.regexp_replace(F.btrim(text), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit(""))


def clamped(score: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.least(F.greatest(F.coalesce(score.try_cast("double"), F.lit(0.0)), F.lit(low)), F.lit(high))


def with_citations(answer: Column, ids: Column) -> Column:
    """The answer, with the sources named at its end if it names none."""
    marks = F.array_join(F.transform(ids, lambda i: F.concat(F.lit("["), i, F.lit("]"))), " ")
    return F.when(has_citation(answer) | (F.size(ids) == 0), answer).otherwise(F.concat(answer, F.lit("\n\n主要依据："), marks))


def labelled(fields: dict[str, Column]) -> Column:
    """Lines of 'Label: value'."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), F.coalesce(v, F.lit(""))) for k, v in fields.items()])


def sorted_json(attributes: Column) -> Column:
    """A map of strings as JSON, keys sorted; {} for null."""
    return F.coalesce(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(attributes)))), F.lit("{}"))


def chunk_key(stable_id: Column, source: Column, page: Column, chunk_id: Column) -> Column:
    """The stable id, else source|page|chunk where all three are there, else ''."""
    parts = F.when((source != "") & (page != "") & (chunk_id != ""), F.concat_ws("|", source, page, chunk_id))
    return F.coalesce(F.nullif(F.btrim(stable_id), F.lit("")), parts, F.lit(""))
