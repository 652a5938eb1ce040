"""Sections to chapters: labels, levels, splits and merges, per document.

Input is a DataFrame of sections (doc_id, pos, type, level, text). One shuffle on
doc_id serves all windows of a document; only merging folds an array, as it depends
on running sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.layout import MAX_SECTIONS, MIN_SECTIONS


def _document():
    return Window.partitionBy("doc_id")


def _so_far():
    return _document().orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def type_histogram(sections: DataFrame) -> DataFrame:
    return sections.groupBy("doc_id", "type").agg(F.count("*").alias("n"))


def titles(sections: DataFrame, stem: Column | None = None) -> DataFrame:
    """(doc_id, title): the first level-1 heading, else the file's stem."""
    own = (F.col("type") == "heading") & (F.col("level") == 1)
    return sections.groupBy("doc_id").agg(F.coalesce(F.min_by(F.when(own, F.col("text")), F.when(own, F.col("pos"))), stem if stem is not None else F.lit("")).alias("title"))


def with_title(sections: DataFrame) -> DataFrame:
    own = (F.col("type") == "heading") & (F.col("level") == 1)
    return sections.withColumn("title", F.coalesce(F.min_by(F.when(own, F.col("text")), F.when(own, F.col("pos"))).over(_document()), F.lit("")))


def split_levels(sections: DataFrame, requested: int | None = None) -> DataFrame:
    """(doc_id, split_level): the first of 2, 1, 3 with two headings or more besides the title, else 2; 0 to 4 on request."""
    if requested in (0, 1, 2, 3, 4):
        return sections.select("doc_id").distinct().withColumn("split_level", F.lit(requested))
    own = with_title(sections).where((F.col("type") == "heading") & (F.col("text") != F.col("title")))
    n = own.groupBy("doc_id").agg(*(F.count_if(F.col("level") == k).alias(f"n{k}") for k in (1, 2, 3)))
    pick = F.when(F.col("n2") >= 2, 2).when(F.col("n1") >= 2, 1).when(F.col("n3") >= 2, 3).otherwise(2)
    return sections.select("doc_id").distinct().join(n.select("doc_id", pick.alias("split_level")), "doc_id", "left").select("doc_id", F.coalesce("split_level", F.lit(2)).alias("split_level"))


def label_chapters(sections: DataFrame, level: int = 2) -> DataFrame:
    """Sections with the chapter each stands in: the last heading of that level so far, first the title."""
    own = F.when((F.col("type") == "heading") & (F.col("level") == level), F.col("text"))
    return with_title(sections).withColumn("chapter", F.coalesce(F.last(own, ignorenulls=True).over(_so_far()), F.col("title"))).drop("title")


def chunk_rows(sections: DataFrame, level: int = 2) -> DataFrame:
    """Sections with chunk, heading and parent of the chapter split at `level`.

    A heading above the level leads the next chunk; text after it stays in the one
    before. A chunk without a heading of the level is the last one; it is named by
    its first heading, else the parent, else the title.
    """
    rows = with_title(sections)
    named = (F.col("type") == "heading") & (F.col("text") != F.col("title"))
    split, above = named & (F.col("level") == level), named & (F.col("level") < level)
    rows = rows.withColumn("s", F.coalesce(split, F.lit(False))).withColumn("p", F.coalesce(above, F.lit(False)))
    rows = rows.withColumn("k", F.sum(F.col("s").cast("int")).over(_so_far())).withColumn("up", F.last(F.when(F.col("p"), F.col("text")), ignorenulls=True).over(_so_far()))
    rows = rows.withColumn("chunk", F.when(F.col("s"), F.col("k")).when(F.col("p"), F.col("k") + 1).otherwise(F.greatest("k", F.lit(1))))
    own = Window.partitionBy("doc_id", "chunk")
    first = lambda flag, c: F.min_by(F.when(flag, F.col(c)), F.when(flag, F.col("pos"))).over(own)
    rows = rows.withColumn("has", F.max("s").over(own)).withColumn("h1", first(F.col("s"), "text")).withColumn("p1", first(F.col("s"), "up")).withColumn("h2", first(F.col("type") == "heading", "text")).withColumn("p2", F.max_by("up", "pos").over(own))
    rows = rows.withColumn("parent", F.when(F.col("has"), F.col("p1")).otherwise(F.col("p2")))
    return rows.withColumn("heading", F.when(F.col("has"), F.col("h1")).otherwise(F.coalesce("h2", "p2", "title"))).select(*sections.columns, "chunk", "heading", "parent")


def chapters(sections: DataFrame, level: int = 2) -> DataFrame:
    """(doc_id, chunk, heading, parent, section_count, positions)."""
    return chunk_rows(sections, level).groupBy("doc_id", "chunk").agg(F.first("heading").alias("heading"), F.first("parent").alias("parent"), F.count("*").alias("section_count"), F.array_sort(F.collect_list("pos")).alias("positions"))


def merge_chapters(split: DataFrame, least: int = MIN_SECTIONS, most: int = MAX_SECTIONS) -> DataFrame:
    """Chapters after joining each to the buffer before it: same parent (null equals null), buffer under `least`, `most` at most together.

    (doc_id, index from 1, heading, parent, headings, section_count, positions)
    """
    item = F.struct("heading", "parent", F.array("heading").alias("headings"), F.col("section_count").cast("long").alias("section_count"), "positions")
    lists = split.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk", item.alias("c")))).alias("l"))
    kind = "array<struct<heading:string,parent:string,headings:array<string>,section_count:bigint,positions:array<int>>>"

    def step(done, x):
        c, last = x["c"], F.element_at(done, -1)
        joins = (F.size(done) > 0) & last["parent"].eqNullSafe(c["parent"]) & (last["section_count"] < least) & (last["section_count"] + c["section_count"] <= most)
        both = F.struct(last["heading"].alias("heading"), last["parent"].alias("parent"), F.concat(last["headings"], c["headings"]).alias("headings"), (last["section_count"] + c["section_count"]).alias("section_count"), F.concat(last["positions"], c["positions"]).alias("positions"))
        return F.when(F.coalesce(joins, F.lit(False)), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(both))).otherwise(F.concat(done, F.array(c))).cast(kind)

    merged = lists.withColumn("l", F.transform("l", lambda x: F.struct(x["chunk"].alias("chunk"), F.struct(x["c"]["heading"].alias("heading"), x["c"]["parent"].alias("parent"), x["c"]["headings"].alias("headings"), x["c"]["section_count"].alias("section_count"), x["c"]["positions"].cast("array<int>").alias("positions")).alias("c"))))
    folded = merged.select("doc_id", F.aggregate("l", F.array().cast(kind), step).alias("m"))
    return folded.select("doc_id", F.posexplode("m").alias("i", "c")).select("doc_id", (F.col("i") + 1).alias("index"), "c.*")


def max_chunk_size(sections: DataFrame, level: int = 2) -> DataFrame:
    """(doc_id, max_size): most sections from one heading of the level to the next; all of them if there is none."""
    rows = with_title(sections)
    split = F.coalesce((F.col("type") == "heading") & (F.col("text") != F.col("title")) & (F.col("level") == level), F.lit(False))
    rows = rows.withColumn("k", F.sum(split.cast("int")).over(_so_far())).groupBy("doc_id", "k").agg(F.count("*").alias("n"))
    return rows.groupBy("doc_id").agg(F.coalesce(F.max(F.when(F.col("k") > 0, F.col("n"))), F.sum("n")).alias("max_size"))


# Rules for diagrams in the order in which they are tried: label, pattern, diagram type.
RULES = [
    ("状态/生命周期", "状态机|生命周期|状态转换|checkpoint|savepoint|状态后端|RUNNING|FINISHED|CANCELED|状态切换", "stateDiagram-v2"),
    ("时序/交互", "时序|水位线|watermark|event\\s*time|窗口触发|提交流程|握手|交互过程|请求.*响应|心跳", "sequenceDiagram"),
    ("架构/组件分层", "架构|体系结构|JobManager|TaskManager|ResourceManager|Dispatcher|Slot|槽位|Master|Worker|集群组成|组件|节点角色|分层|层次结构", "graph TD + subgraph"),
    ("数据流/管道", "Source.*Sink|数据流向|数据管道|pipeline|算子链|DataStream.*Transform|流转过程|数据流转|上游.*下游|输入.*处理.*输出", "graph LR"),
    ("流程/步骤", "流程|步骤|第[一二三四五1-9]步|首先.*然后|执行过程|启动过程|提交作业|工作流程|处理流程|调用过程|步骤如下", "graph TD (流程图)"),
    ("分类/层级树", "分为|可分成|包括以下|主要有|划分为|种类|分类|几大类|类型有|归为|由.*组成|包含.*和.*以及", "graph LR (树/分类)"),
    ("对比/差异", "对比|区别|相比|不同点|差异|vs\\b|与.*的比较|批.*流|有界.*无界|优缺点|两者.*不同", "Markdown 表格 或 并排 subgraph"),
]
MIN_RULE_TEXT = 12


def diagram_suggestions(sections: DataFrame, level: int = 2, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """(doc_id, section_index, chapter, trigger, diagram_type, context, match_count): the first match of each chapter and diagram type, with the count."""
    rows = label_chapters(sections, level).where(F.col("type").isin("paragraph", "heading", "list_item") & (F.length("text") >= MIN_RULE_TEXT))
    number = None
    for i, (_, pattern, _) in enumerate(rules):
        cond = F.col("text").rlike("(?d)" + pattern)
        number = F.when(cond, i) if number is None else number.when(cond, i)
    rows = rows.withColumn("rule", number).where("rule is not null")
    names = F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(i), F.struct(F.lit(r[0]).alias("trigger"), F.lit(r[2]).alias("diagram_type")))))[F.col("rule")]
    rows = rows.select("doc_id", "pos", "chapter", "text", names.alias("r"))
    return rows.groupBy("doc_id", "chapter", F.col("r.diagram_type").alias("diagram_type")).agg(F.min("pos").alias("section_index"), F.min_by("r.trigger", "pos").alias("trigger"), F.substring(F.min_by("text", "pos"), 1, 80).alias("context"), F.count("*").alias("match_count"))


def type_summary(suggestions: DataFrame) -> DataFrame:
    """(diagram_type, n) by falling count."""
    return suggestions.groupBy("diagram_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "diagram_type")
