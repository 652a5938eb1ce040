"""Line dedup by a log-template tree, in DataFrame operations alone.

Tokens that hold a digit or an @ are variable fields at once, where at least half of the
line is constant. The tree has a fixed depth: a line's leaf is its token count and its
first LEADING tokens. A leaf with several lines is generalised: at each position, its
template has the token that most documents have there, MIN_DOCS at least. A line that
differs from that in up to a fifth of its tokens, MAX_FIELDS at most, is of the leaf's
template, and the positions in which such lines differ are its further variable fields.
A template recurs if MIN_DOCS documents have lines of it: all of them lose these lines,
but the document with the smallest id. A leaf has one such template; its other lines,
and those of leaves without one, recur as they are, fields masked: in LONG_DOCS
documents if the line is long, in SHORT_DOCS if it is short, in MIN_DOCS otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Store, table

MIN_DOCS, MIN_TOKENS = 3, 4
#: The tree: leading tokens of a leaf, share (one in FIELD_SHARE) and number of a line's tokens that may be fields besides those masked.
LEADING, FIELD_SHARE, MAX_FIELDS = 3, 5, 5
#: A line is long by tokens or by characters, not short by either (scripts without spaces have one token a line).
LONG_TOKENS, LONG_CHARS, LONG_DOCS = 20, 120, 2
SHORT_CHARS, SHORT_DOCS = 20, 5
#: Remainders of open leaves that are broadcast, 2^20 at most, spare other lines' text the shuffle; they do not decide anything.
REMAINDERS = 1 << 20

#: What makes a line untidy, besides a space at either end.
_UNTIDY = ("  ", "\t", "\x0b", "\f", "\r")


def _each(column: Column, f) -> Column:
    return F.transform(column, f)


def _less(x: Column, part: str) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(part), F.lit("")))


def _tokens(x: Column) -> Column:
    return _less(x, " ") + 1


def _tidy(x: Column) -> Column:
    untidy = x.startswith(" ") | x.endswith(" ")
    for part in _UNTIDY:
        untidy = untidy | x.contains(part)
    return F.when(untidy, F.trim(F.regexp_replace(x, "[ \\t\\x0B\\f\\r]+", " "))).otherwise(x)


def _fields(x: Column, tokens: Column) -> Column:
    """A tidy line with its fields masked; null where it has none or is short."""
    return F.when((tokens >= MIN_TOKENS) & x.rlike("[0-9@]"), F.regexp_replace(x, "[^ 0-9@]*+[0-9@][^ ]*+", "<*>"))


def _masked(x: Column, fields: Column, tokens: Column) -> Column:
    """Of a tidy line, the line with its fields masked, or itself where it is short or less than half constant; null for blank lines."""
    return F.when(2 * _less(fields, "<*>") <= 3 * tokens, fields).when(x != "", x)


def _key(x: Column, tokens: Column) -> Column:
    """Key of a masked line, whose last two bits tell short (0), middle (1) and long (2) lines; null for blank ones."""
    kind = F.when((tokens >= LONG_TOKENS) | (F.length(x) >= LONG_CHARS), 2).when((tokens >= MIN_TOKENS) | (F.length(x) >= SHORT_CHARS), 1).otherwise(0)
    return F.when(x.isNotNull(), F.shiftleft(F.xxhash64(x), 2) + kind)


def _leaf(x: Column, tokens: Column) -> Column:
    """Key of a masked line's leaf; null where the line is too short for a field."""
    return F.when(tokens >= FIELD_SHARE, F.xxhash64(tokens, F.substring_index(x, " ", LEADING)))


def line_keys(text: Column) -> Column:
    """Of each line of a text, its key. Each transform binds what the next one needs more than once."""
    tidy = _each(_each(F.split(text, "\n"), _tidy), lambda x: F.struct(x.alias("x"), _tokens(x).alias("n")))
    fields = _each(tidy, lambda s: F.struct(s["x"].alias("x"), s["n"].alias("n"), _fields(s["x"], s["n"]).alias("f")))
    return _each(_each(fields, lambda s: F.struct(_masked(s["x"], s["f"], s["n"]).alias("x"), s["n"].alias("n"))), lambda s: _key(s["x"], s["n"]))


def masked_lines(docs: DataFrame) -> DataFrame:
    """(doc, masked, tokens) of each line of `docs` that isn't blank, as often as it stands there."""
    lines = docs.select(F.col("doc_id").alias("doc"), F.explode(F.split("text", "\n")).alias("x")).where(F.col("x").rlike("[^ \\t\\x0B\\f\\r]"))
    tidy = lines.select("doc", _tidy(F.col("x")).alias("x"))
    counted = tidy.select("doc", "x", _tokens(F.col("x")).alias("tokens"))
    fields = counted.select("doc", "x", "tokens", _fields(F.col("x"), F.col("tokens")).alias("f"))
    return fields.select("doc", _masked(F.col("x"), F.col("f"), F.col("tokens")).alias("masked"), "tokens")


def _open_leaves(lines: DataFrame) -> DataFrame:
    """Leaves of several different lines, in MIN_DOCS documents."""
    return lines.where("leaf is not null").groupBy("leaf").agg(F.count("*").alias("__lines"), F.sum("n").alias("__n")).where((F.col("__lines") >= 2) & (F.col("__n") >= MIN_DOCS)).select("leaf")


def template_members(docs: DataFrame, lines: DataFrame, store: Store) -> DataFrame:
    """(line, leaf) of each line that is of its leaf's template, by (line, leaf, n: documents that have it) of all lines of `docs`."""
    leaves = store.keep(_open_leaves(lines), "leaves")
    remainders = leaves.select(F.pmod("leaf", F.lit(REMAINDERS)).alias("__open")).distinct()
    marked = masked_lines(docs).select("masked", "tokens", _leaf(F.col("masked"), F.col("tokens")).alias("leaf"))
    # Inner and null-safe, since a semi-join or a filter for nulls would be pushed below and compute each line's leaf once more; the right sides' rows are distinct.
    near = marked.withColumn("__rest", F.pmod("leaf", F.lit(REMAINDERS))).join(F.broadcast(remainders), F.col("__rest").eqNullSafe(F.col("__open"))).drop("__rest", "__open")
    # Never null (no line here is blank), since the join by line below would be given a filter for nulls that masks each line several times more.
    key = F.coalesce(_key(F.col("masked"), F.col("tokens")), F.lit(0).cast("long"))
    texts = near.join(leaves.withColumnRenamed("leaf", "__leaf"), F.col("leaf").eqNullSafe(F.col("__leaf"))).withColumn("line", key).groupBy("line").agg(F.first("masked").alias("masked"))
    texts = store.keep(texts.join(lines.where("leaf is not null"), "line").select("line", "leaf", "n", F.split("masked", " ").alias("tokens")), "tokens")
    tokens = texts.select("line", "leaf", "n", F.size("tokens").alias("size"), F.posexplode("tokens").alias("pos", "token")).where(F.col("pos") >= LEADING)
    most = tokens.groupBy("leaf", "pos", "token").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_DOCS).groupBy("leaf", "pos").agg(F.min(F.struct(-F.col("n"), "token")).alias("s")).select("leaf", "pos", F.col("s.token").alias("token"))
    fits = tokens.join(most, ["leaf", "pos", "token"]).groupBy("line", "leaf", "size").agg(F.count("*").alias("fit"))
    fields = F.col("size") - LEADING - F.col("fit")
    return fits.where((FIELD_SHARE * fields <= F.col("size")) & (fields <= MAX_FIELDS)).select("line", "leaf")


def dedup_lines(docs: DataFrame, store: Store | None = None) -> DataFrame:
    """`docs`, all columns, with `text` less its recurring lines, and n_lines and n_dropped (columns of those names are replaced).

    Lines are split at line feeds; the rest is joined with them. All but blank lines
    take part. A null text stays null and has no lines; an empty one has one blank
    line. Rows with one doc_id are one document, rows without doc_id are one that comes
    after all others. A line or template that comes several times in its first document
    stays there as often. Of tokens that equally many documents have at a position, a
    leaf's template has the first in the order of UTF-8 bytes.
    """
    store = store or Store(docs.sparkSession, "lines")
    per = masked_lines(docs).select("doc", _key(F.col("masked"), F.col("tokens")).alias("line"), _leaf(F.col("masked"), F.col("tokens")).alias("leaf"))
    per = store.keep(per.groupBy("line", "leaf", "doc").agg(F.lit(1).alias("one")).select("line", "leaf", "doc"), "lines")
    counted = store.keep(per.groupBy("line", "leaf").agg(F.count("*").alias("n"), F.min("doc").alias("first")), "counted")
    kind = F.col("line").bitwiseAND(F.lit(3))
    often = counted.where(F.col("n") >= F.when(kind == 2, LONG_DOCS).when(kind == 1, MIN_DOCS).otherwise(SHORT_DOCS)).select("line", "first")

    members = store.keep(template_members(docs, counted.select("line", "leaf", "n"), store), "members")
    templates = per.join(members.select("line"), "line").groupBy("leaf", "doc").agg(F.lit(1).alias("one")).groupBy("leaf").agg(F.count("*").alias("n"), F.min("doc").alias("first")).where(F.col("n") >= MIN_DOCS)
    of_template = members.join(templates.select("leaf", F.col("first").alias("__first")), "leaf").select("line", "__first")
    often = often.join(of_template, "line", "full_outer").select("line", F.coalesce("__first", "first").alias("first"))

    dropped = per.select("line", "doc").join(often, "line").where(~F.col("doc").eqNullSafe(F.col("first"))).groupBy("doc").agg(F.collect_list("line").alias("__dropped"))
    joined = docs.drop("n_lines", "n_dropped").join(dropped, F.col("doc_id").eqNullSafe(F.col("doc")), "left").drop("doc")
    lines = F.split("text", "\n")
    kept = F.transform(F.filter(F.arrays_zip(lines.alias("line"), line_keys(F.col("text")).alias("key")), lambda x: F.coalesce(~F.array_contains(F.col("__dropped"), x["key"]), F.lit(True))), lambda x: x["line"])
    kept = F.when(F.col("__dropped").isNotNull(), kept).otherwise(lines)
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    joined = joined.select(*names, F.coalesce(F.size(lines), F.lit(0)).alias("__n"), kept.alias("__kept"))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.col("__n"))
    return joined.select(*(F.array_join("__kept", "\n").alias("text") if c == "text" else c for c in names), n.cast("long").alias("n_lines"), F.when(F.col("text").isNull(), 0).otherwise(F.col("__n") - F.size("__kept")).cast("long").alias("n_dropped"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of dedup_lines over all documents."""
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP3_SQL = f"""WITH
  cut AS (SELECT row_number() OVER () AS r, doc_id, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS l FROM documents),
  line AS (SELECT r, doc_id, unnest(range(len(l))) AS pos, unnest(l) AS x FROM cut),
  tidy AS (SELECT *, trim(regexp_replace(x, '[ \\t\\x0B\\f\\r]+', ' ', 'g'), ' ') AS y FROM line),
  masked AS (SELECT *, regexp_replace(y, '[^ ]*[0-9@][^ ]*', '<*>', 'g') AS z, len(string_split(y, ' ')) AS n FROM tidy),
  keyed AS (SELECT r, doc_id, pos, x, n, CASE WHEN n >= {MIN_TOKENS} AND 2 * len(list_filter(string_split(z, '<*>'), lambda a, i: i > 1)) <= n THEN z WHEN y <> '' THEN y END AS k FROM masked),
  counted AS (SELECT k, min(n) AS n, min(doc_id) AS first, count(DISTINCT coalesce(cast(doc_id AS VARCHAR), '-')) AS docs FROM keyed WHERE k IS NOT NULL GROUP BY k),
  often AS (SELECT k, first FROM counted WHERE docs >= CASE WHEN n >= {LONG_TOKENS} OR length(k) >= {LONG_CHARS} THEN {LONG_DOCS} WHEN n >= {MIN_TOKENS} OR length(k) >= {SHORT_CHARS} THEN {MIN_DOCS} ELSE {SHORT_DOCS} END),
  placed AS (SELECT k, n, docs, array_to_string(string_split(k, ' ')[1:{LEADING}], ' ') AS lead FROM counted WHERE n >= {FIELD_SHARE}),
  leaf AS (SELECT n, lead FROM placed GROUP BY n, lead HAVING count(*) >= 2 AND sum(docs) >= {MIN_DOCS}),
  token AS (SELECT k, n, lead, docs, unnest(range(n)) AS p, unnest(string_split(k, ' ')) AS t FROM placed JOIN leaf USING (n, lead)),
  support AS (SELECT n, lead, p, t, sum(docs) AS docs FROM token WHERE p >= {LEADING} GROUP BY n, lead, p, t HAVING sum(docs) >= {MIN_DOCS}),
  most AS (SELECT n, lead, p, t FROM support QUALIFY row_number() OVER (PARTITION BY n, lead, p ORDER BY docs DESC, t) = 1),
  fit AS (SELECT k, n, lead, n - {LEADING} - count(*) AS fields FROM token JOIN most USING (n, lead, p, t) GROUP BY k, n, lead),
  member AS (SELECT k, n, lead FROM fit WHERE {FIELD_SHARE} * fields <= n AND fields <= {MAX_FIELDS}),
  template AS (SELECT m.n, m.lead, min(doc_id) AS first FROM keyed e JOIN member m USING (k) GROUP BY m.n, m.lead HAVING count(DISTINCT coalesce(cast(doc_id AS VARCHAR), '-')) >= {MIN_DOCS}),
  of_template AS (SELECT k, first FROM member JOIN template USING (n, lead)),
  recurs AS (SELECT k, coalesce(t.first, o.first) AS first FROM often o FULL JOIN of_template t USING (k)),
  marked AS (SELECT e.*, o.k IS NOT NULL AND e.doc_id IS DISTINCT FROM o.first AS gone FROM keyed e LEFT JOIN recurs o ON e.k = o.k),
  per AS (SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, coalesce(string_agg(x, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept FROM marked GROUP BY r)
SELECT c.doc_id, coalesce(p.n_lines, 0)::BIGINT AS n_lines, coalesce(p.n_dropped, 0)::BIGINT AS n_dropped, sha256(coalesce(p.kept, '')) AS kept_sha256 FROM cut c LEFT JOIN per p ON c.r = p.r"""
