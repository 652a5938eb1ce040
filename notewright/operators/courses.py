"""Course packages: folders, slides and task notes as one document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import layout as L
from ..functions import text as T
from ..functions.rx import find_all, split_lines, strip
from .lint import join_slide_lines, mermaid_warnings, repair_mermaid

# Folders that hold task notes, in order of preference; texts of the document's parts.
MD_FOLDERS = ("md版本", "md版", "md")
OVERVIEW, SLIDES = "> 共 {} 份实操文档", "，{} 份课件"
TASKS = "## 动手实操\n\n> 以下为配套实操任务，包含环境配置、Step-by-step 操作步骤和截图验证。"
BREAK = "\n\n---\n\n"


def md_folders(folders: DataFrame) -> DataFrame:
    """(package, folder) of `folders` (package, folder): the preferred folder of each package, else the first that begins with md."""
    place = F.coalesce(*(F.when(F.col("folder") == x, F.lit(i)) for i, x in enumerate(MD_FOLDERS)), F.lit(len(MD_FOLDERS)))
    able = folders.where(F.col("folder").isin(*MD_FOLDERS) | F.lower("folder").rlike("\\Amd"))
    return able.groupBy("package").agg(F.min_by("folder", F.struct(place, "folder")).alias("folder"))


def next_number(folders: DataFrame, pattern: str = "\\A(\\d+)_") -> DataFrame:
    """(package, number): one more than the largest number that begins a folder's name; 1 without any."""
    found = F.regexp_extract("folder", pattern, 1)
    return folders.groupBy("package").agg((F.coalesce(F.max(F.when(found != "", found.cast("long"))), F.lit(0)) + 1).alias("number"))


def sequence_names(items: DataFrame, key: str, order: str, template: str = "image%03d") -> DataFrame:
    """`items` with `name`, numbered from 1 within the key."""
    return items.withColumn("name", F.format_string(template, F.row_number().over(Window.partitionBy(key).orderBy(order))))


def slide(lines: Column, cells: Column) -> Column:
    """struct<title, body> of a slide's lines, less those that repeat a table cell; null for slides of two lines or fewer."""
    own = F.filter(F.transform(lines, strip), lambda x: x != "")
    body = F.filter(F.slice(own, 2, F.greatest(F.size(own), F.lit(1))), lambda x: ~F.array_contains(cells, x))
    return F.when(F.size(own) > 2, F.struct(own[0].alias("title"), join_slide_lines(L.slide_lines(body)).alias("body")))


def slide_decks(pages: DataFrame) -> DataFrame:
    """(deck, abstract, body) of pages (deck, page, text, cells): page 0 is the cover, whose lines make the abstract; other slides make sections."""
    lines = split_lines(F.col("text"))
    one = pages.select("deck", "page", F.when(F.col("page") == 0, L.cover_abstract(lines)).alias("abstract"), F.when(F.col("page") > 0, slide(lines, F.coalesce("cells", F.array().cast("array<string>")))).alias("s"))
    part = F.when(F.col("s").isNotNull(), F.concat(F.lit("### "), F.col("s.title"), F.when(F.col("s.body") != "", F.concat(F.lit("\n\n"), F.col("s.body"))).otherwise("")))
    one = one.select("deck", "page", "abstract", part.alias("part"))
    return one.groupBy("deck").agg(F.coalesce(F.max("abstract"), F.lit("")).alias("abstract"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("page", "part")))), lambda x: x["part"]), "\n\n").alias("body"))


def frontmatter_text(title: Column, course: Column, tags: list[str], date: Column) -> Column:
    listed = "".join(f"  - {t}\n" for t in tags)
    return F.concat(F.lit('---\ntitle: "'), title, F.lit('"\ncourse: "'), course, F.lit(f'"\ntags:\n{listed}date: '), date, F.lit("\n---\n"))


def course_documents(packages: DataFrame, decks: DataFrame, tasks: DataFrame, tags: list[str]) -> DataFrame:
    """(package, md): one document for each of `packages` (package, title, course, date), of its `decks` (package, pos, name, abstract, body) and `tasks` (package, pos, name, md).

    Heading, abstracts and overview come first, then the decks, then the tasks, whose top headings go down a level.
    """
    in_order = lambda part: F.transform(F.array_sort(F.collect_list(F.struct("pos", part.alias("x")))), lambda s: s["x"])
    d = decks.groupBy("package").agg(F.count("*").alias("n_decks"), F.filter(in_order(strip(F.col("abstract"))), lambda x: x != "").alias("abstracts"), in_order(F.concat(F.lit("## "), "name", F.lit("\n\n"), strip(F.col("body")))).alias("decks"))
    t = tasks.groupBy("package").agg(F.count("*").alias("n_tasks"), in_order(F.concat(F.lit("## "), "name", F.lit("\n\n"), strip(T.demote_h1(F.col("md"))))).alias("tasks"))
    none = F.array().cast("array<string>")
    both = packages.join(d, "package", "left").join(t, "package", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    over = F.concat(F.lit(OVERVIEW.split("{}")[0]), n("n_tasks"), F.lit(OVERVIEW.split("{}")[1]), F.when(n("n_decks") > 0, F.concat(F.lit(SLIDES.split("{}")[0]), n("n_decks"), F.lit(SLIDES.split("{}")[1]))).otherwise(""))
    head = F.array_join(F.concat(F.array(F.concat(F.lit("# "), "title")), F.coalesce("abstracts", none), F.array(over)), "\n\n")
    body = F.array_join(F.concat(F.array(head), F.coalesce("decks", none), F.array(F.lit(TASKS)), F.coalesce("tasks", none)), BREAK)
    return both.select("package", F.concat(frontmatter_text(F.col("title"), F.col("course"), tags, F.col("date")), F.lit("\n"), body).alias("md"))


def rewrite_diagrams(md: Column) -> Column:
    """struct<md, blocks, fixed, warnings>: all Mermaid blocks of a note repaired, with how many there are, were changed, and what structural warnings remain."""
    pattern = "(?s)```mermaid\\n(.*?)```"
    parts, blocks = F.split(md, "(?s)```mermaid\\n.*?```"), find_all(md, pattern, 1)
    repaired = F.transform(blocks, lambda b: repair_mermaid(b))
    text = F.transform(F.arrays_zip(parts.alias("a"), repaired.alias("b")), lambda x: F.concat(x["a"], F.when(x["b"].isNotNull(), F.concat(F.lit("```mermaid\n"), x["b"], F.lit("```"))).otherwise("")))

    def warned(b):
        w = mermaid_warnings(b)
        return (w["unbalanced"] != 0).cast("int") + F.size(w["subgraph_arrows"]) + F.size(w["unknown_styles"]) + w["odd_start"].cast("int")

    return F.struct(
        F.array_join(text, "").alias("md"), F.size(blocks).alias("blocks"), F.size(F.filter(F.arrays_zip(blocks.alias("a"), repaired.alias("b")), lambda x: x["a"] != x["b"])).alias("fixed"),
        F.aggregate(F.transform(repaired, warned), F.lit(0), lambda a, x: a + x).alias("warnings"),
    )
