"""Fences, lint rules and repairs of Markdown notes: (note_id, md) in, rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rx import find_all, split_lines, strip

# First words of diagrams.
DIAGRAM_TYPES = ["flowchart", "graph", "sequencediagram", "classdiagram", "statediagram", "statediagram-v2", "erdiagram", "gantt", "pie", "mindmap", "timeline", "gitgraph", "xychart-beta", "block-beta", "quadrantchart", "sankey-beta", "requirementdiagram", "c4context"]
# Beginnings of diagrams that repair accepts, with case.
REPAIR_STARTS = ["graph ", "flowchart ", "sequenceDiagram", "classDiagram", "stateDiagram", "erDiagram", "gantt", "pie", "mindmap", "gitGraph", "timeline", "xychart"]


def fence_ranges(lines: Column) -> Column:
    """array<struct<s, e>> of closed fences, from 0. A fence of any language ends at a line of its three characters alone; one that doesn't end has no range."""
    kind = "struct<i:int,open:int,mark:string,out:array<struct<s:int,e:int>>>"
    start = F.struct(F.lit(0).alias("i"), F.lit(-1).alias("open"), F.lit("").alias("mark"), F.array().cast("array<struct<s:int,e:int>>").alias("out")).cast(kind)

    def step(a, raw):
        x, opened = strip(raw), a["open"] >= 0
        closes, opens = opened & (x == a["mark"]), ~opened & x.rlike("\\A(```|~~~)")
        one = F.array(F.struct(a["open"].alias("s"), a["i"].alias("e")))
        return F.struct(
            (a["i"] + 1).alias("i"), F.when(closes, F.lit(-1)).when(opens, a["i"]).otherwise(a["open"]).alias("open"),
            F.when(closes, F.lit("")).when(opens, F.substring(x, 1, 3)).otherwise(a["mark"]).alias("mark"), F.when(closes, F.concat(a["out"], one)).otherwise(a["out"]).alias("out"),
        ).cast(kind)

    return F.aggregate(lines, start, step, lambda a: a["out"])


def mermaid_blocks(lines: Column) -> Column:
    """array<struct<start, n, closed>>: line number of the opening fence from 1, number of content lines, whether it is closed."""
    kind = "struct<i:int,open:int,mark:string,out:array<struct<start:int,n:int,closed:boolean>>>"
    start = F.struct(F.lit(0).alias("i"), F.lit(-1).alias("open"), F.lit("").alias("mark"), F.array().cast("array<struct<start:int,n:int,closed:boolean>>").alias("out")).cast(kind)
    block = lambda a, closed: F.array(F.struct((a["open"] + 1).alias("start"), (a["i"] - a["open"] - 1).alias("n"), F.lit(closed).alias("closed")))

    def step(a, raw):
        x, opened = strip(raw), a["open"] >= 0
        closes, opens = opened & (x == a["mark"]), ~opened & x.isin("```mermaid", "~~~mermaid")
        return F.struct(
            (a["i"] + 1).alias("i"), F.when(closes, F.lit(-1)).when(opens, a["i"]).otherwise(a["open"]).alias("open"),
            F.when(closes, F.lit("")).when(opens, F.substring(x, 1, 3)).otherwise(a["mark"]).alias("mark"), F.when(closes, F.concat(a["out"], block(a, True))).otherwise(a["out"]).alias("out"),
        ).cast(kind)

    return F.aggregate(lines, start, step, lambda a: F.when(a["open"] >= 0, F.concat(a["out"], block(a, False))).otherwise(a["out"]))


def _issue(level: str, code: str, line: Column) -> Column:
    return F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), line.cast("int").alias("line"))


_NONE = "array<struct<level:string,code:string,line:int>>"


def _block_issues(b: Column, lines: Column) -> Column:
    content = F.slice(lines, b["start"] + 1, b["n"])
    kind = F.element_at(F.split(F.lower(strip(content[0])), "\\s+"), 1)

    def line_issues(x, i):
        at = b["start"] + 1 + i
        edge = F.exists(find_all(x, "\\|([^|\\n]+)\\|", 1), lambda m: ~strip(m).rlike('(?s)\\A".*"\\z|\\A"\\z') & (F.contains(F.lower(m), F.lit("<br")) | F.contains(m, F.lit("\\n"))))
        paren = F.exists(find_all(x, "\\(+([^)]+)\\)+", 1), lambda m: F.contains(F.lower(m), F.lit("<br")))
        return F.filter(
            F.array(
                F.when(kind.isin("flowchart", "graph") & edge, _issue("ERROR", "E1", at)), F.when((kind == "mindmap") & paren, _issue("WARN", "W1", at)), F.when((kind == "timeline") & F.contains(F.lower(x), F.lit("<br")), _issue("WARN", "W4", at)),
                F.when(F.contains(x, F.lit("\\n")), _issue("WARN", "W2", at)), F.when(F.contains(x, F.lit("<br />")), _issue("WARN", "W3", at)),
            ),
            lambda y: y.isNotNull(),
        )

    inner = F.filter(F.flatten(F.transform(content, lambda x, i: F.when(i > 0, line_issues(x, i)).otherwise(F.array().cast(_NONE)))), lambda y: y.isNotNull())
    type_ = F.when(~F.coalesce(kind, F.lit("")).isin(DIAGRAM_TYPES), F.array(_issue("ERROR", "E3", b["start"]))).otherwise(F.array().cast(_NONE))
    return F.when(~b["closed"], F.array(_issue("ERROR", "E2", b["start"]))).when(b["n"] == 0, F.array().cast(_NONE)).otherwise(F.concat(type_, inner))


def lint_issues(notes: DataFrame, compat: bool = False) -> DataFrame:
    """(note_id, level, code, line) of notes (note_id, md). compat: skip, like some tools, the line before a fence instead of its last for rule E4."""
    rows = notes.select("note_id", split_lines(F.col("md")).alias("lines"))
    rows = rows.select("note_id", "lines", mermaid_blocks(F.col("lines")).alias("blocks"), fence_ranges(F.col("lines")).alias("fences"))
    lines, fences = F.col("lines"), F.col("fences")
    inside = lambda i: F.exists(fences, lambda f: (f["s"] <= i) & (i <= f["e"]))
    mermaid = F.flatten(F.transform("blocks", lambda b: _block_issues(b, lines)))
    code = lambda x: F.concat(find_all(x, "`([^`\\n]+)`", 1), find_all(x, "<code>([^<\\n]+)</code>", 1))
    queries = F.flatten(F.transform(lines, lambda x, i: F.when(inside(i + 1 if compat else i), F.array().cast(_NONE)).otherwise(F.transform(F.filter(code(x), lambda m: m.rlike("(?U)\\A\\s*=")), lambda m: _issue("ERROR", "E4", i + 1)))))
    gap = F.filter(F.transform(lines, lambda x, i: F.when(~inside(i) & x.rlike("(?U)</div>\\s*\\z") & F.coalesce(F.get(lines, i + 1).rlike("(?U)\\A\\s*>"), F.lit(False)), _issue("ERROR", "E5", i + 2))), lambda y: y.isNotNull())
    every = F.concat(mermaid.cast(_NONE), queries.cast(_NONE), gap.cast(_NONE))
    return rows.select("note_id", F.explode(every).alias("x")).select("note_id", "x.*")


def lint_tally(issues: DataFrame) -> DataFrame:
    return issues.groupBy("level", "code").agg(F.count("*").alias("n"))


def repair_tables(md: Column) -> Column:
    """struct<md, fixes>: `||` at a line's start opened up, and a blank line before a table that follows text."""
    lines = F.split(md, "(?<=\\n)")
    lines = F.filter(lines, lambda x: x != "")
    opened = F.transform(lines, lambda x: F.when(F.startswith(x, F.lit("||")), F.concat(F.lit("| "), F.substr(x, F.lit(2)))).otherwise(x))
    row = lambda x: x.rlike("(?U)\\A\\s*\\|")
    gap = lambda x, i: row(x) & (i > 0) & F.coalesce((strip(F.get(opened, i - 1)) != "") & ~row(F.get(opened, i - 1)), F.lit(False))
    out = F.transform(opened, lambda x, i: F.when(gap(x, i), F.concat(F.lit("\n"), x)).otherwise(x))
    n = F.size(F.filter(lines, lambda x: F.startswith(x, F.lit("||")))) + F.size(F.filter(opened, gap))
    return F.struct(F.array_join(out, "").alias("md"), n.alias("fixes"))


def join_slide_lines(lines: Column) -> Column:
    """Formatted lines as paragraphs: list items in one block, callouts alone, text in one block."""
    kind = "struct<last:string,out:string>"

    def step(a, x):
        now = F.when(F.startswith(x, F.lit("> [!")), "callout").when(F.startswith(x, F.lit("- ")), "list").otherwise("text")
        between = F.when(a["last"] == "", "").when((now == a["last"]) & (now != "callout"), "\n").otherwise("\n\n")
        return F.struct(now.alias("last"), F.concat(a["out"], between, x).alias("out")).cast(kind)

    return F.aggregate(lines, F.struct(F.lit("").alias("last"), F.lit("").alias("out")).cast(kind), step, lambda a: a["out"])


def repair_mermaid(block: Column, compat: bool = False) -> Column:
    """A diagram with literal or, in compat mode, real line ends inside quotes as <br/>; by default quotes are paired within their line."""
    if compat:
        segments = F.split(block, '"')
        fixed = F.transform(segments, lambda x, i: F.when((i % 2 == 1) & (i < F.size(segments) - 1), F.replace(F.replace(x, F.lit("\\n"), F.lit("<br/>")), F.lit("\n"), F.lit("<br/>"))).otherwise(x))
        return F.array_join(fixed, '"')
    lines = F.split(block, "\n")

    def one(line):
        parts = F.split(line, '"')
        return F.array_join(F.transform(parts, lambda x, i: F.when((i % 2 == 1) & (i < F.size(parts) - 1), F.replace(x, F.lit("\\n"), F.lit("<br/>"))).otherwise(x)), '"')

    return F.array_join(F.transform(lines, one), "\n")


def mermaid_warnings(block: Column) -> Column:
    """struct of a diagram's structural warnings: subgraphs minus ends, subgraphs used by arrows, styles of unknown nodes, odd first line."""
    subs = F.array_distinct(find_all(block, "(?dm)^\\s*subgraph\\s+([A-Za-z_][A-Za-z0-9_]*)", 1))
    arrows = F.filter(find_all(block, "(?dm)^\\s*[A-Za-z_].*-->.*$"), lambda x: ~x.rlike("\\A\\s*subgraph\\s"))
    ends = F.flatten(F.transform(arrows, lambda x: F.concat(find_all(x, "\\b([A-Za-z_][A-Za-z0-9_]*)\\s*--", 1), find_all(x, "--[^>]*>\\s*([A-Za-z_][A-Za-z0-9_]*)\\b", 1))))
    ids = F.flatten(F.array(*(find_all(block, p, 1) for p in ("(?dm)^\\s*([A-Za-z_][A-Za-z0-9_]*)\\s*[\\[({|\"<]", "(?dm)^\\s*([A-Za-z_][A-Za-z0-9_]*)\\s*-->", "-->\\s*([A-Za-z_][A-Za-z0-9_]*)", "(?dm)^\\s*([A-Za-z_][A-Za-z0-9_]*)\\s*--"))))
    first = F.split(strip(block), "\n")[0]
    good = first == ""
    for s in REPAIR_STARTS:
        good = good | F.startswith(first, F.lit(s))
    return F.struct(
        (F.size(find_all(block, "\\bsubgraph\\b")) - F.size(find_all(block, "(?dm)^\\s*end\\s*$"))).alias("unbalanced"), F.array_sort(F.array_intersect(subs, ends)).alias("subgraph_arrows"),
        F.array_except(find_all(block, "(?dm)^\\s*style\\s+(\\S+)", 1), ids).alias("unknown_styles"), (~good).alias("odd_start"),
    )
