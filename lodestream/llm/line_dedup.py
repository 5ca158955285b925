"""Line dedup by a fixed-depth log-template tree, in DataFrame functions only.

A line goes down the tree by its token count and its first ``depth`` tokens, a token with a digit counting as
the variable field ``<*>``. Each leaf holds any number of templates:

1. The most widespread line of the leaf is a seed. Lines whose tokens equal the seed's in at least ``similarity`` of
   the places belong to its template, in which the other places become variable.
2. Any other line generalises by itself: a token that stands at its place of the leaf in ``min_docs`` or more
   different texts is constant, all others are variable. If at least ``similarity`` of the places are constant, the
   line belongs to the template of its constant tokens.
3. What is left is a template by its own tokens.

A template that occurs in ``min_docs`` or more different texts (exact copies count once) is boilerplate, and so is a
line of ``long_tokens`` or more that stands as it is in ``long_docs`` different texts. Such lines are dropped from
every document but the first, by id, so that one copy stays.

Only hashes are shuffled until the few leaves that can recur are known; common lines are counted by partial
aggregation before any shuffle.

Defined results: null text stays null and has no lines; lines without tokens, or with under ``min_tokens``,
stay; a null id counts as the last document; repeated rows lose the same lines; a text whose lines are all
dropped becomes empty. Line ends are ``\\n``. Input columns with the names of results are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.session import written

DEPTH = 3
SIMILARITY = 0.7
MIN_DOCS = 10
MIN_TOKENS = 4
LONG_TOKENS, LONG_DOCS = 50, 2
SPACE = r"[\\x20\\x09-\\x0D]+"
LAST = (1 << 63) - 1


def _hash(text: str) -> str:
    """60 bits of MD5: the same in other SQL engines."""
    return f"cast(conv(substr(md5({text}), 1, 15), 16, 10) as bigint)"


def parsed_lines(docs: DataFrame, doc_id: str, text: str, depth: int, min_tokens: int) -> DataFrame:
    """One row a line that can be a template: doc, text_hash, line_no, masked, n, leaf, line."""
    # byte searches find the few texts with other than single blanks; masked inside the array, each line is read once
    odd = " OR ".join(["startswith(t, ' ')", "endswith(t, ' ')"] + [f"contains(t, '{x}')" for x in ("  ", " \\n", "\\n ", "\\t", "\\r", "\\u000b", "\\u000c")])
    plain = f"CASE WHEN {odd} THEN transform(split(t, '\\n'), l -> trim(regexp_replace(l, '{SPACE}', ' '))) ELSE split(t, '\\n') END"
    mask = "CASE WHEN l rlike '[0-9]' THEN regexp_replace(l, '[^ ]*[0-9][^ ]*', '<*>') ELSE l END"
    arrays = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("t"))
    arrays = arrays.select("doc", "text_hash", F.expr(plain).alias("lines")).withColumn("lines", F.expr(f"transform(lines, l -> {mask})"))
    out = arrays.select("doc", "text_hash", F.posexplode("lines").alias("line_no", "masked"))
    out = out.withColumn("n", F.expr("octet_length(masked) - octet_length(replace(masked, ' ', '')) + 1")).where(F.col("n") >= min_tokens)
    leaf = f"concat(n, ' ', substring_index(masked, ' ', {depth}))"
    return out.withColumns({"leaf": F.expr(_hash(leaf)), "line": F.expr(_hash("masked"))})


def find_templates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", depth: int = DEPTH, similarity: float = SIMILARITY, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, long_tokens: int = LONG_TOKENS, long_docs: int = LONG_DOCS
) -> tuple[DataFrame, DataFrame]:
    """(lines that are in recurring templates, templates).

    Lines: doc, text_hash, line_no, leaf, template, exact. Templates: leaf, template, exact, n_texts, first_doc. A long
    line is asked for by itself too (exact).
    """
    lines = parsed_lines(docs, doc_id, text, depth, min_tokens)
    counts = lines.groupBy("leaf", "line").agg(F.countDistinct("text_hash").alias("k"))
    leaves = counts.groupBy("leaf").agg(F.max_by("line", F.struct("k", "line")).alias("seed"), F.sum("k").alias("k"))
    leaves = written(leaves.where(F.col("k") >= min_docs).select("leaf", "seed"), "leaves")

    # of other leaves only the hashes of long lines go on
    every = lines.join(leaves, "leaf", "left").where((F.col("n") >= long_tokens) | F.col("seed").isNotNull())
    every = written(every.withColumn("masked", F.expr("CASE WHEN seed IS NOT NULL THEN masked END")), "lines")
    near = every.where("seed IS NOT NULL")
    # every text of one hash is the same, so any row can speak for the seed
    seeds = written(near.where("line = seed").groupBy("leaf").agg(F.min("masked").alias("seed_line")), "seeds")
    equal = "size(filter(zip_with(split(masked, ' '), split(seed_line, ' '), (a, b) -> a = b AND a != '<*>'), x -> x))"
    fits = F.expr(f"masked = seed_line OR {equal} >= {similarity} * n").alias("fits")
    placed = near.drop("seed").join(seeds, "leaf").select("doc", "text_hash", "line_no", "leaf", "line", "n", "masked", fits)

    # the leading tokens are those of the leaf, so they are constant anyway
    rest = placed.where("NOT fits")
    tokens = F.posexplode(F.split("masked", " ")).alias("pos", "token")
    common = rest.select("leaf", "text_hash", tokens).where((F.col("pos") >= depth) & (F.col("token") != "<*>"))
    common = written(common.groupBy("leaf", "pos", "token").agg(F.countDistinct("text_hash").alias("k")).where(F.col("k") >= min_docs).select("leaf", "pos", "token", F.lit(True).alias("constant")), "tokens")
    leading = F.size(F.filter(F.slice(F.split("masked", " "), 1, depth), lambda x: x != "<*>")).alias("leading")
    own = rest.select("leaf", "line", "n", "masked", leading).distinct().select("leaf", "line", "n", "leading", tokens).where(F.col("pos") >= depth)
    own = own.join(common, ["leaf", "pos", "token"], "left").withColumn("token", F.expr("CASE WHEN constant THEN token ELSE '<*>' END"))
    shapes = own.groupBy("leaf", "line", "n", "leading").agg(F.count("constant").alias("constant"), F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("shape"))
    shapes = shapes.where((F.col("leading") + F.col("constant") >= similarity * F.col("n")) & (F.col("leading") + F.col("constant") < F.col("n")))
    shapes = shapes.select("leaf", "line", F.expr(_hash("array_join(transform(shape, x -> x.token), ' ')")).alias("shape"))

    placed = placed.drop("masked").join(written(shapes, "shapes"), ["leaf", "line"], "left")
    placed = placed.select("doc", "text_hash", "line_no", "leaf", F.expr("CASE WHEN fits THEN -1L ELSE coalesce(shape, line) END").alias("template"), F.lit(False).alias("exact"))
    long = every.where(F.col("n") >= long_tokens)
    placed = placed.unionByName(long.select("doc", "text_hash", "line_no", "leaf", F.col("line").alias("template"), F.lit(True).alias("exact")))
    templates = placed.groupBy("leaf", "template", "exact").agg(F.countDistinct("text_hash").alias("n_texts"), F.min("doc").alias("first_doc"))
    templates = written(templates.where(F.expr(f"n_texts >= CASE WHEN exact THEN {long_docs} ELSE {min_docs} END")), "templates")  # both sides of the join can be split
    return placed.join(templates.select("leaf", "template", "exact", "first_doc"), ["leaf", "template", "exact"]), templates


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings: float) -> DataFrame:
    """docs without the lines of recurring templates; n_lines and n_dropped are added."""
    lines, _ = find_templates(docs, doc_id, text, **settings)
    drop = lines.where("doc > first_doc").groupBy("doc", "text_hash").agg(F.collect_set("line_no").alias("_drop"))
    aside = {c: f"_own_{c}" for c in ("doc", "text_hash") if c in docs.columns}  # clashing names step aside
    doc_id, text = aside.get(doc_id, doc_id), aside.get(text, text)
    out = docs.drop("n_lines", "n_dropped", "_drop").withColumnsRenamed(aside)
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "_drop")]
    out = out.withColumns({"doc": F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)), "text_hash": F.xxhash64(text)})
    out = out.join(drop, ["doc", "text_hash"], "left").drop("doc", "text_hash")
    out = out.withColumn("_pieces", F.split(F.col(text), "\n"))
    left = "array_join(transform(array_except(sequence(0, size(_pieces) - 1), _drop), i -> _pieces[i]), '\\n')"
    result = F.struct(
        F.when(F.col("_pieces").isNull(), 0).otherwise(F.size("_pieces")).cast("long").alias("n_lines"),
        F.when(F.col("_drop").isNull(), 0).otherwise(F.size("_drop")).cast("long").alias("n_dropped"),
        F.when(F.col("_drop").isNull(), F.col(text)).otherwise(F.expr(left)).alias("text"),
    )
    # a generator of one row: filters on what is left of the text stay above it, so no line is cut out twice
    out = out.withColumn("_out", F.explode(F.array(result))).drop("_drop", "_pieces")
    out = out.withColumns({text: F.col("_out.text"), "n_lines": F.col("_out.n_lines"), "n_dropped": F.col("_out.n_dropped")}).drop("_out")
    return out.withColumnsRenamed({v: k for k, v in aside.items()}).select(*names, "n_lines", "n_dropped")


def oracle() -> str:
    """DuckDB SQL for op7."""
    h = "CAST('0x' || substr(md5({}), 1, 15) AS BIGINT)"
    return rf"""
WITH l AS (
  SELECT doc_id, text, i - 1 AS line_no,
         regexp_replace(trim(regexp_replace(lines[i], '[\x20\x09-\x0D]+', ' ', 'g')), '[^ ]*[0-9][^ ]*', '<*>', 'g') AS masked
  FROM (SELECT doc_id, text, string_split(text, chr(10)) AS lines, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
p AS (
  SELECT *, string_split(masked, ' ') AS tok, len(string_split(masked, ' ')) AS n FROM l WHERE len(string_split(masked, ' ')) >= {MIN_TOKENS}),
q AS (
  SELECT *, {h.format(f"CAST(n AS VARCHAR) || ' ' || array_to_string(tok[1:{DEPTH}], ' ')")} AS leaf, {h.format("masked")} AS line FROM p),
c AS (SELECT leaf, line, any_value(tok) AS tok, count(DISTINCT text) AS k FROM q GROUP BY leaf, line),
s AS (
  SELECT leaf, line AS seed, tok AS seed_tok FROM c
  QUALIFY row_number() OVER (PARTITION BY leaf ORDER BY k DESC, line DESC) = 1),
a AS (
  SELECT q.*, line = seed OR len(list_filter(range(1, n + 1), lambda j: tok[j] = seed_tok[j] AND tok[j] <> '<*>')) >= {SIMILARITY} * n AS fits
  FROM q JOIN s USING (leaf)),
e AS (SELECT leaf, line, text, tok, n, unnest(range(1, n + 1)) AS pos FROM a WHERE NOT fits),
k AS (
  SELECT leaf, pos, tok[pos] AS token FROM e WHERE pos > {DEPTH} AND tok[pos] <> '<*>' GROUP BY leaf, pos, tok[pos] HAVING count(DISTINCT text) >= {MIN_DOCS}),
g AS (
  SELECT e.leaf, line, any_value(n) AS n, count(*) FILTER (WHERE token IS NOT NULL OR (e.pos <= {DEPTH} AND tok[e.pos] <> '<*>')) AS constant,
         string_agg(coalesce(token, '<*>'), ' ' ORDER BY e.pos) FILTER (WHERE e.pos > {DEPTH}) AS shape
  FROM (SELECT DISTINCT leaf, line, tok, n, pos FROM e) e LEFT JOIN k ON k.leaf = e.leaf AND k.pos = e.pos AND k.token = e.tok[e.pos]
  GROUP BY e.leaf, line),
b AS (
  SELECT a.*, CASE WHEN fits THEN -1 WHEN g.constant >= {SIMILARITY} * g.n AND g.constant < g.n THEN {h.format("g.shape")} ELSE a.line END AS template
  FROM a LEFT JOIN g USING (leaf, line)),
z AS (
  SELECT doc_id, text, line_no, leaf, template, false AS exact FROM b
  UNION ALL SELECT doc_id, text, line_no, leaf, line, true FROM b WHERE n >= {LONG_TOKENS}),
t AS (
  SELECT leaf, template, exact, min(doc_id) AS first_doc FROM z GROUP BY leaf, template, exact
  HAVING count(DISTINCT text) >= CASE WHEN exact THEN {LONG_DOCS} ELSE {MIN_DOCS} END),
d AS (SELECT DISTINCT z.doc_id, z.line_no FROM z JOIN t USING (leaf, template, exact) WHERE z.doc_id > t.first_doc),
x AS (SELECT doc_id, list(line_no) AS drops FROM d GROUP BY doc_id)
SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines,
       CAST(coalesce(len(drops), 0) AS BIGINT) AS n_dropped,
       CASE WHEN drops IS NULL THEN text ELSE
         array_to_string(list_transform(list_filter(range(1, len(string_split(text, chr(10))) + 1), lambda i: NOT list_contains(drops, i - 1)), lambda i: string_split(text, chr(10))[i]), chr(10)) END AS text
FROM documents LEFT JOIN x USING (doc_id)"""
