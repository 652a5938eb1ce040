"""Scalar text functions on Markdown notes and source text: Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rx import find_all, split_lines, strip

# Technology keywords in the order in which they are tried, and their official names.
TECH = {
    "flink": "Apache Flink", "spark": "Apache Spark", "kafka": "Apache Kafka", "hadoop": "Apache Hadoop", "hive": "Apache Hive", "hbase": "Apache HBase", "zookeeper": "Apache ZooKeeper",
    "redis": "Redis", "elasticsearch": "Elasticsearch", "rabbitmq": "RabbitMQ", "nginx": "Nginx", "kubernetes": "Kubernetes", "docker": "Docker", "spring": "Spring Framework",
    "springboot": "Spring Boot", "spring boot": "Spring Boot", "mybatis": "MyBatis", "mysql": "MySQL", "postgresql": "PostgreSQL", "dubbo": "Apache Dubbo", "pyflink": "Apache Flink", "pyspark": "Apache Spark",
}
# Method names too common to be claims.
NOISE = ["get", "set", "add", "put", "run", "main", "new", "for", "map", "on", "of", "at", "to", "is", "in", "it", "by", "do", "if"]
# Symbols that make recognised text look like code.
CODE_SYMBOLS = "{};()=<>.:/\"'#"
# Keywords of web pages' technologies, in order of preference, and official names.
WEB_TECH = {
    "flink": "Apache Flink", "spark": "Apache Spark", "kafka": "Apache Kafka", "hadoop": "Apache Hadoop", "hive": "Apache Hive", "hbase": "Apache HBase", "zookeeper": "Apache ZooKeeper", "redis": "Redis",
    "elasticsearch": "Elasticsearch", "rabbitmq": "RabbitMQ", "nginx": "Nginx", "kubernetes": "Kubernetes", "docker": "Docker", "spring": "Spring Framework", "springboot": "Spring Boot", "spring boot": "Spring Boot",
    "mybatis": "MyBatis", "mysql": "MySQL", "postgresql": "PostgreSQL", "dubbo": "Apache Dubbo", "pyflink": "Apache Flink", "pyspark": "Apache Spark", "claude": "Claude API", "openai": "OpenAI API",
    "langchain": "LangChain", "vue": "Vue.js", "react": "React", "golang": "Go", "python": "Python", "java": "Java",
}
JVM, CONFIG = ["java", "scala", "kotlin", "groovy", ""], ["yaml", "yml", "properties", "ini", "conf", "toml"]


def strip_to_prose(c: Column, variant: str = "document") -> Column:
    """A note's prose. "document" drops fenced code and formulas; "web" keeps the code inside fences."""
    c = F.regexp_replace(c, "(?Uds)\\A\\s*+---\\n.*?\\n---\\n", "")
    if variant == "document":
        c = F.replace(F.regexp_replace(c, "(?s)```.*?```", ""), F.lit("```"), F.lit(""))
        c = F.regexp_replace(F.regexp_replace(c, "(?s)\\$\\$.*?\\$\\$", ""), "\\$[^$\\n]++\\$", "")
    else:
        c = F.replace(F.regexp_replace(c, "```[^\\n]*+\\n", ""), F.lit("```"), F.lit(""))
    c = F.regexp_replace(F.regexp_replace(c, "<[^>]++>", ""), "(?U)\\[!\\w++\\][-+]?", "")
    c = F.translate(c, "|", " ")
    c = F.regexp_replace(c, "(?Udm)^[#>\\s]++", "")
    c = F.regexp_replace(c, "(?Udm)^[-*]\\s++", "")
    c = F.regexp_replace(c, "(?Udm)^[-:\\s|]+$", "")
    return F.translate(c, "*`>", "")


def count_chars(c: Column) -> Column:
    """Characters that aren't white space."""
    return F.length(F.regexp_replace(c, "(?U)[\\s\\x1C-\\x1F]++", ""))


def html_text(c: Column) -> Column:
    """Without tags; five entities decoded one after the other, so doubly encoded ones decode twice."""
    c = F.regexp_replace(c, "<[^>]++>", "")
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def span_text(html: Column) -> Column:
    """Text of all rich-text spans of an editor page, joined without a separator."""
    return F.array_join(F.transform(find_all(html, '(?s)<span[^>]*data-slate-string="true"[^>]*>(.*?)</span>', 1), html_text), "")


def numbers(c: Column) -> Column:
    """Distinct number tokens, in order of first appearance."""
    return F.array_distinct(find_all(c, "(?U)\\d++(?:\\.\\d++)?"))


def long_enumerations(c: Column, min_items: int = 5) -> Column:
    """Items of each run of short items that ideographic commas join, where so many items are left."""
    # No try inside a run: a long text without commas would be read again from each character.
    runs = find_all(c, "(?<![^，。；！？、\\n])[^，。；！？、\\n]++(?:、[^，。；！？、\\n]++)++")
    items = F.transform(runs, lambda r: F.filter(F.transform(F.split(r, "、"), lambda x: F.regexp_replace(strip(x), "[…. ]++\\z", "")), lambda x: F.length(x).between(1, 12)))
    return F.filter(items, lambda x: F.size(x) >= min_items)


def missing_numbers(source: Column, note: Column) -> Column:
    """Numbers of the source that the raw note doesn't contain."""
    return F.filter(numbers(source), lambda n: ~F.contains(note, n))


def dropped_enumerations(source: Column, note: Column, ratio: float = 0.6) -> Column:
    """Long enumerations of which at least `ratio` of the items are not in the note."""
    return F.filter(long_enumerations(source), lambda e: F.size(F.filter(e, lambda x: ~F.contains(note, x))) >= ratio * F.size(e))


def frontmatter_block(md: Column) -> Column:
    """The lines between a note's leading --- lines, or null."""
    found = F.regexp_extract(md, "(?sd)\\A---\\n(.*?)\\n---\\n", 1)
    return F.when(md.rlike("(?sd)\\A---\\n.*?\\n---\\n"), found)


def strip_frontmatter(md: Column) -> Column:
    return F.regexp_replace(md, "(?sd)\\A---\\n.*?\\n---\\n", "")


def _unquote(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(strip(c), '\\A"++|"++\\z', ""), "\\A'++|'++\\z", "")


def frontmatter_value(md: Column, key: str) -> Column:
    """The last value of a key, without quotes; null if there is none."""
    found = find_all(frontmatter_block(md), f"(?Udm)^{key}:[ \\t]*+(.*)$", 1)
    return _unquote(F.element_at(F.when(F.size(found) > 0, found), -1))


def frontmatter_tags(md: Column) -> Column:
    """Tags from a list in brackets or, without one, from lines of their own."""
    block = frontmatter_block(md)
    inline = F.regexp_extract(block, "(?dm)^tags:\\s*\\[(.*?)\\]", 1)
    listed = find_all(F.regexp_extract(block, "(?Udm)^tags:[ \\t]*+\\n((?:[ \\t]++-[ \\t]++[^\\n]*+(?:\\n|\\z))*+)", 1), "(?Udm)^\\s++-\\s++(.*)$", 1)
    tags = F.when(block.rlike("(?dm)^tags:\\s*\\[.*?\\]"), F.filter(F.split(inline, ","), lambda t: strip(t) != "")).otherwise(listed)
    return F.coalesce(F.transform(tags, _unquote), F.array().cast("array<string>"))


def infer_tech(*parts: Column, version: Column | None = None, keywords: dict[str, str] | None = None) -> Column:
    """Official name of the first keyword that the joined parts contain, else the name before the version's number, if there is one, or an empty string."""
    text = F.lower(F.concat_ws(" ", *parts))
    name = F.lit("") if version is None else strip(F.regexp_extract(version, "\\A([A-Za-z][A-Za-z\\s]+?)\\s+\\d", 1))
    return F.coalesce(*(F.when(F.contains(text, F.lit(k)), F.lit(v)) for k, v in (keywords or TECH).items()), name)


def version_number(c: Column) -> Column:
    return F.regexp_extract(c, "(\\d+\\.\\d+[\\.\\d]*)", 1)


def fenced_blocks(body: Column) -> Column:
    """array<struct<lang, content>> of fenced blocks whose language is a word or missing."""
    p = "(?s)```(\\w*)\\n(.*?)```"
    return F.transform(F.arrays_zip(find_all(body, p, 1).alias("lang"), find_all(body, p, 2).alias("content")), lambda x: F.struct(strip(F.lower(x["lang"])).alias("lang"), x["content"].alias("content")))


def _claims(body: Column, langs: list[str], pattern: str, group: int = 1) -> Column:
    own = F.filter(fenced_blocks(body), lambda b: b["lang"].isin(langs))
    return F.flatten(F.transform(own, lambda b: find_all(b["content"], pattern, group)))


def _sorted_set(c: Column) -> Column:
    return F.array_sort(F.array_distinct(c))


_STATIC, _METHOD = "\\b([A-Z][A-Za-z0-9_]+)\\.([a-zA-Z][A-Za-z0-9_]+)\\s*[\\(<]", "\\.([a-z][A-Za-z0-9_]+)\\s*\\("


def claim_imports(body: Column) -> Column:
    return _sorted_set(F.concat(_claims(body, JVM, "(?dm)^import\\s+([\\w\\.]+(?:\\.\\*)?)\\s*;?"), _claims(body, ["python"], "(?dm)^(?:from|import)\\s+([\\w\\.]+)")))


def claim_classes(body: Column) -> Column:
    inline = find_all(body, "`([A-Z][A-Za-z0-9_]+(?:\\.[A-Za-z][A-Za-z0-9_]*)*)`", 1)
    every = F.concat(_claims(body, JVM, "\\bnew\\s+([A-Z][A-Za-z0-9_]+)\\s*[(<]"), _claims(body, [*JVM, "python"], _STATIC), inline)
    return F.filter(_sorted_set(every), lambda x: F.length(x) > 2)


def claim_methods(body: Column) -> Column:
    every = F.concat(_claims(body, [*JVM, "python"], _STATIC, 2), _claims(body, [*JVM, "python"], _METHOD))
    return F.filter(_sorted_set(every), lambda x: (F.length(x) > 2) & ~x.isin(NOISE))


def claim_configs(body: Column) -> Column:
    return F.filter(_sorted_set(_claims(body, CONFIG, "(?dm)^([a-z][a-z0-9_.\\-]+)\\s*[:=]")), lambda k: F.contains(k, F.lit(".")) | F.contains(k, F.lit("_")))


def code_languages(body: Column) -> Column:
    return F.filter(_sorted_set(F.transform(fenced_blocks(body), lambda b: b["lang"])), lambda x: x != "")


def versions_mentioned(body: Column) -> Column:
    p = "\\b([A-Z][A-Za-z]+(?:\\s[A-Za-z]+)?)\\s+(\\d+\\.\\d+[\\.\\d]*)\\b"
    return F.array_distinct(F.transform(F.arrays_zip(find_all(body, p, 1).alias("a"), find_all(body, p, 2).alias("b")), lambda x: F.concat_ws(" ", x["a"], x["b"])))


def deprecated_names(body: Column) -> Column:
    """Identifiers in the lines of warning callouts, not in their title line, first ones first."""
    text = F.transform(find_all(body, "(?i)>\\s*+\\[!WARNING\\][^\\n]*+\\n((?:>[^\\n]*+\\n?)*+)", 1), lambda x: F.regexp_replace(x, "(?dm)^>\\s*", ""))
    p = "`([A-Za-z][A-Za-z0-9_\\.]+)`|([A-Z][A-Za-z0-9_]+)"
    names = F.flatten(F.transform(text, lambda x: F.transform(F.arrays_zip(find_all(x, p, 1).alias("a"), find_all(x, p, 2).alias("b")), lambda y: F.when(F.coalesce(y["a"], F.lit("")) != "", y["a"]).otherwise(y["b"]))))
    return F.array_distinct(F.filter(names, lambda n: n != ""))


def urls(md: Column) -> Column:
    """array<struct<url, is_image>>: links and images first, then bare URLs not right after a bracket; the first of a URL counts."""
    link = "(!?)\\[[^\\]]*+\\]\\((https?://[^) \\t\\n]+)\\)"
    marked = F.transform(F.arrays_zip(find_all(md, link, 2).alias("u"), find_all(md, link, 1).alias("i")), lambda x: F.struct(x["u"].alias("url"), (x["i"] == "!").alias("is_image")))
    bare = F.transform(find_all(md, "(?<!\\()(https?://[^\\s)\"'<>]+)", 1), lambda u: F.struct(F.regexp_replace(u, "[.,;)]++\\z", "").alias("url"), F.lit(False).alias("is_image")))
    every = F.concat(marked, bare)
    names = F.transform(every, lambda x: x["url"])
    return F.filter(every, lambda x, i: F.array_position(names, x["url"]) == i + 1)


def code_score(c: Column) -> Column:
    return F.length(c) - F.length(F.translate(c, CODE_SYMBOLS, ""))


def collapse_blank(c: Column) -> Column:
    return F.regexp_replace(c, "\\n{3,}+", "\n\n")


def demote_h1(c: Column) -> Column:
    return F.regexp_replace(c, "(?dm)^# (.+)$", "## $1")


def safe_title(c: Column) -> Column:
    """A title as a file name."""
    return F.regexp_replace(F.regexp_replace(c, "(?U)[^\\w一-鿿\\-]", "_"), "\\A_++|_++\\z", "")


def output_name(explicit: Column, number: Column, title: Column, folder: Column) -> Column:
    """The explicit name with .md, else two digits and the title, else the folder's name."""
    named = F.when(F.endswith(explicit, F.lit(".md")), explicit).otherwise(F.concat(explicit, F.lit(".md")))
    digits = F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number)
    return F.coalesce(named, F.concat(digits, F.lit(" "), title, F.lit(".md")), F.concat(safe_title(folder), F.lit(".md")))


def read_lines(c: Column) -> Column:
    return split_lines(c)
