"""The same results in DuckDB SQL, one string per query of ``catalog``.

Queries without an entry have no SQL equivalent: trained models and what is
built from them.
"""

WS = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_" + WS + "]"


def strip(text: str) -> str:
    text = f"""regexp_replace({text}, '(?s)\"\"\".*?\"\"\"', '', 'g')"""
    text = f"""regexp_replace({text}, '(?s)''''''.*?''''''', '', 'g')"""
    return f"""regexp_replace({text}, '#[^\\n]*', '', 'g')"""


def flat(text: str) -> str:
    return f"regexp_replace({text}, '[{WS}]+', ' ', 'g')"


def tokens(text: str) -> str:
    return f"len(regexp_extract_all({text}, '{TOKEN}'))::INTEGER"


def rnd(expr: str, digits: int = 6) -> str:
    """Rounded, with minus zero turned into zero."""
    return f"(round({expr}, {digits}) + 0.0)"


def metrics(counts: str, keys: str) -> str:
    return f"""
    SELECT {keys}, true_negative, false_positive, false_negative, true_positive,
      {rnd("coalesce((true_positive + true_negative)::DOUBLE / nullif(true_positive + true_negative + false_positive + false_negative, 0), 0.0)")} AS accuracy,
      {rnd("coalesce(true_positive::DOUBLE / nullif(true_positive + false_positive, 0), 0.0)")} AS "precision",
      {rnd("coalesce(true_positive::DOUBLE / nullif(true_positive + false_negative, 0), 0.0)")} AS recall,
      {rnd("coalesce(2.0 * true_positive / nullif(2 * true_positive + false_positive + false_negative, 0), 0.0)")} AS f1_score
    FROM ({counts})"""


def confusion(long: str, keys: str) -> str:
    return f"""
    SELECT {keys},
      count(*) FILTER (actual = 0 AND pred = 0)::BIGINT AS true_negative,
      count(*) FILTER (actual = 0 AND pred = 1)::BIGINT AS false_positive,
      count(*) FILTER (actual = 1 AND pred = 0)::BIGINT AS false_negative,
      count(*) FILTER (actual = 1 AND pred = 1)::BIGINT AS true_positive
    FROM ({long}) GROUP BY {keys}"""


def binary_from(long: str, keys: str) -> str:
    return metrics(confusion(long, keys), keys)


PREDICTED = f"""
    SELECT d.doc_id, d.lang, l.quality, l.toxic, (length({strip("d.text")}) > 500)::INTEGER AS pred
    FROM documents d JOIN labels l USING (doc_id)"""

LONG_PREDICTED = f"""
    SELECT doc_id, lang, 'quality' AS node_type, quality AS actual, pred FROM ({PREDICTED})
    UNION ALL SELECT doc_id, lang, 'toxic', toxic, pred FROM ({PREDICTED})"""

LONG_LABELS = """
    SELECT doc_id, 'quality' AS node_type, quality AS label FROM labels
    UNION ALL SELECT doc_id, 'toxic', toxic FROM labels"""

DAYS = """
    SELECT user_id, ts::DATE AS day, min_by(event_type, (ts, event_id)) AS deleted,
      list_sort(list_distinct(list(event_type))) AS original,
      list_sort(list_distinct(list(event_type ORDER BY ts, event_id)[2:])) AS edited
    FROM events GROUP BY user_id, ts::DATE"""

MODEL_PATHS = """
    SELECT doc_id, lang, source, pooler, concat_ws('_', 'output/base', pooler, source, doc_id) AS path
    FROM (SELECT d.*, concat_ws('-', CASE WHEN quality = 1 THEN 'cls' END, CASE WHEN toxic = 1 THEN 'max' END,
                                CASE WHEN n_chars > 1000 THEN 'mean' END) AS pooler
          FROM documents d JOIN labels USING (doc_id))"""

KINDS = "['rule_point', 'back_seq', 'front_seq', 'all_point']"

DOCUMENT_PAIRS = f"""
    SELECT doc_id, lang, source, text AS cleaned_code, edited_code,
      round(length(edited_code)::DOUBLE / length(text), 6) AS kept,
      {KINDS}[1 + ('0x' || substr(md5(source), 1, 8))::BIGINT % 4] AS pruning_type
    FROM (SELECT *, {strip("text")} AS edited_code FROM documents)"""

TURNS = f"SELECT conv_id AS file, turn, role, text AS code, {tokens('text')} AS token_count FROM conversations"

FIRST_TURNS = f"SELECT * FROM ({TURNS}) QUALIFY row_number() OVER (PARTITION BY file ORDER BY turn) = 1"


def longest(chars: int) -> str:
    return f"""
    SELECT file, token_count FROM ({FIRST_TURNS})
    WHERE length(code) <= {chars} AND token_count <= 510 ORDER BY token_count DESC, file LIMIT 1"""


COSINES = """
    SELECT a.vec_id AS source_id, b.vec_id AS target_id, a.label || '_' || b.label AS "index",
      a.label AS source, b.label AS target,
      list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c
    FROM embeddings a, embeddings b"""

POOLED = """
    WITH dims AS (
      SELECT vec_id // 5 AS doc, vec_id % 5 AS pos, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS dim
      FROM embeddings),
    sized AS (SELECT *, max(pos) OVER (PARTITION BY doc) AS last FROM dims)
    SELECT doc, dim::INTEGER AS dim, max(v) FILTER (pos = 0) AS cls,
      max(v) FILTER (pos > 0 AND pos < last) AS max_, avg(v) FILTER (pos > 0 AND pos < last) AS mean
    FROM sized GROUP BY doc, dim"""

CLUSTERS = """
    WITH RECURSIVE near AS MATERIALIZED (
      SELECT a.vec_id AS u, b.vec_id AS v FROM embeddings a, embeddings b
      WHERE a.vec_id = b.vec_id OR list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.4),
    core AS MATERIALIZED (SELECT u FROM near GROUP BY u HAVING count(*) >= 3),
    link AS MATERIALIZED (SELECT u, v FROM near WHERE u IN (FROM core) AND v IN (FROM core)),
    reach(u, v) AS (SELECT u, v FROM link UNION SELECT r.u, l.v FROM reach r JOIN link l ON r.v = l.u),
    roots AS MATERIALIZED (SELECT u, min(v) AS root FROM reach GROUP BY u),
    joined AS (
      SELECT u, root FROM roots
      UNION ALL
      SELECT n.u, min(r.root) FROM near n JOIN roots r ON n.v = r.u WHERE n.u NOT IN (FROM core) GROUP BY n.u),
    ranked AS (SELECT root, (row_number() OVER (ORDER BY root) - 1)::INTEGER AS cluster FROM (SELECT DISTINCT root FROM roots))
    SELECT e.vec_id, e.vec_id IN (FROM core) AS is_core, coalesce(ranked.cluster, -1)::INTEGER AS cluster
    FROM embeddings e LEFT JOIN joined j ON e.vec_id = j.u LEFT JOIN ranked ON j.root = ranked.root"""


def axis(name: str, matrix: str, squarings: int = 16) -> str:
    """The leading axis of a symmetric matrix ``(i, j, v)`` by repeated squaring, turned so that its largest loading is positive."""
    steps = [f"{name}_0 AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM {matrix} WHERE i = j) AS v FROM {matrix})"]
    for n in range(squarings):
        square = f"SELECT a.i, b.j, sum(a.v * b.v) AS v FROM {name}_{n} a JOIN {name}_{n} b ON a.j = b.i GROUP BY a.i, b.j"
        steps.append(f"{name}_{n + 1} AS MATERIALIZED (SELECT i, j, v / sum(v) FILTER (i = j) OVER () AS v FROM ({square}))")
    last = f"{name}_{squarings}"
    column = f"SELECT i, v FROM {last} WHERE j = (SELECT i FROM {last} WHERE i = j ORDER BY v DESC, i LIMIT 1)"
    turned = f"SELECT i, v / sqrt(sum(v * v) OVER ()) * sign(arg_max(v, abs(v)) OVER ()) AS v FROM ({column})"
    return ",\n    ".join([*steps, f"{name} AS MATERIALIZED ({turned})"])


PRINCIPAL = f"""
    WITH dims AS MATERIALIZED (
      SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
    centred AS MATERIALIZED (SELECT vec_id, label, i, x - avg(x) OVER (PARTITION BY i) AS v FROM dims),
    spread AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.v * b.v) AS v FROM centred a JOIN centred b USING (vec_id) GROUP BY a.i, b.i),
    {axis("first", "spread")},
    strength AS (SELECT sum(a.v * s.v * b.v) AS v FROM spread s JOIN first a ON s.i = a.i JOIN first b ON s.j = b.i),
    remains AS MATERIALIZED (SELECT s.i, s.j, s.v - (SELECT v FROM strength) * a.v * b.v AS v FROM spread s JOIN first a ON s.i = a.i JOIN first b ON s.j = b.i),
    {axis("second", "remains")}
    SELECT vec_id, label, (round(sum(c.v * f.v), 6) + 0.0) AS pc0, (round(sum(c.v * s.v), 6) + 0.0) AS pc1
    FROM centred c JOIN first f ON c.i = f.i JOIN second s ON c.i = s.i GROUP BY vec_id, label"""


def hashed(rows: str, text: str, key: str, dim: int) -> str:
    """(key, dim, n): how often each md5 bucket of a token occurs."""
    return f"""
    SELECT {key}, (('0x' || substr(md5(tok), 1, 8))::BIGINT % {dim})::INTEGER AS dim, count(*)::BIGINT AS n
    FROM (SELECT {key}, unnest(regexp_extract_all({text}, '{TOKEN}')) AS tok FROM ({rows})) GROUP BY 1, 2"""


def hashed_cosine(rows: str, key: str, a: str, b: str, dim: int) -> str:
    return f"""
    SELECT k.{key}, coalesce(dot / nullif(sqrt(na) * sqrt(nb), 0), 0.0) AS c
    FROM (SELECT {key} FROM ({rows})) k
    LEFT JOIN (SELECT {key}, sum(n * n)::DOUBLE AS na FROM ({hashed(rows, a, key, dim)}) GROUP BY {key}) USING ({key})
    LEFT JOIN (SELECT {key}, sum(n * n)::DOUBLE AS nb FROM ({hashed(rows, b, key, dim)}) GROUP BY {key}) USING ({key})
    LEFT JOIN (SELECT x.{key}, sum(x.n * y.n)::DOUBLE AS dot
               FROM ({hashed(rows, a, key, dim)}) x JOIN ({hashed(rows, b, key, dim)}) y USING ({key}, dim) GROUP BY x.{key}) USING ({key})"""


def rule(centre: str, scale: str, size: str = "length(text)") -> str:
    return f"1.0 / (1.0 + exp(-greatest(-500.0, least(500.0, ({size} - {centre})::DOUBLE / {scale}))))"


def sampled(rows: str, key: str, n: int, group: str = "") -> str:
    part = f"PARTITION BY {group} " if group else ""
    return f"""
    SELECT * FROM ({rows}) QUALIFY row_number() OVER ({part}ORDER BY md5('42:' || {key}), {key}) <= {n}"""


def shuffled(rows: str, key: str, batch: int) -> str:
    return f"""
    SELECT *, position // {batch} AS batch_id FROM (
      SELECT *, row_number() OVER (ORDER BY md5('42:0:' || {key}), {key}) - 1 AS position FROM ({rows}))"""


def digest_tokens(rows: str, text: str, key: str, dim: int) -> str:
    """(key, dim, cls, max, mean) of the md5 token matrix between its markers."""
    return f"""
    SELECT {key}, d::INTEGER AS dim, any_value(first) AS cls, max(v) AS max_, avg(v) AS mean
    FROM (SELECT {key}, d, {byte("'<s>'", "d")} AS first, CASE WHEN tok IS NOT NULL THEN {byte("tok", "d")} END AS v
          FROM (SELECT r.{key}, t.tok FROM ({rows}) r LEFT JOIN
                  (SELECT {key}, unnest(regexp_extract_all({text}, '{TOKEN}')) AS tok FROM ({rows})) t USING ({key})),
               (SELECT unnest(range({dim})) AS d))
    GROUP BY {key}, d"""


def byte(token: str, d: str) -> str:
    return f"((('0x' || substr(md5({token}), (2 * {d} + 1)::BIGINT, 2))::INTEGER - 127.5)::FLOAT / 127.5::FLOAT)::FLOAT::DOUBLE"


EDIT_LINES = """
    SELECT 'doc' || doc_id AS filename, (pos - 1)::INTEGER AS num, 'doc' || doc_id || '-' || (pos - 1) AS guid,
      md5(text) AS source, line AS target,
      round_even((1 - pos::DOUBLE / n) * (1 - pos::DOUBLE / n) - 1, 3) AS label
    FROM (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, len(string_split(text, chr(10))) AS n,
                 generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)"""

ROUTED = """
    SELECT *, concat_ws(':', user_id, day) AS original_code, concat_ws('-', user_id, day) AS text,
      list_contains(edited, 'click')::INTEGER AS click, list_contains(edited, 'view')::INTEGER AS view,
      CASE WHEN deleted IN ('click', 'view') THEN 'target' WHEN deleted <> 'error' THEN 'others' END AS bucket
    FROM (""" + DAYS + """) WHERE list_contains(original, deleted) <> list_contains(edited, deleted)"""


def _edit_predictions() -> str:
    parts = []
    for i, t in enumerate(("click", "view")):
        parts.append(
            f"SELECT bucket, '{t}' AS node_type, {t} AS actual, ({rule(str(13 + i), '1')} >= 0.5)::INTEGER AS pred"
            f" FROM ({ROUTED}) WHERE bucket IS NOT NULL"
        )
    return " UNION ALL ".join(parts)


SAMPLE_ROWS = f"SELECT doc_id, {strip('text')} AS text, quality, toxic FROM documents JOIN labels USING (doc_id)"


def _sample_predictions() -> str:
    rows = sampled(SAMPLE_ROWS, "doc_id", 60)
    return " UNION ALL ".join(
        f"SELECT '{t}' AS node_type, {t} AS actual, ({rule(c, s)} >= 0.5)::INTEGER AS pred FROM ({rows})"
        for t, c, s in (("quality", "500", "200"), ("toxic", "5000", "900"))
    )


BALANCED = f"""
    WITH long AS MATERIALIZED (
      SELECT l.*, row_number() OVER (PARTITION BY node_type, label ORDER BY md5('42:' || doc_id), doc_id) - 1 AS place,
        count(*) OVER (PARTITION BY node_type, label) AS n
      FROM ({LONG_LABELS}) l),
    half AS (
      SELECT node_type, least(min(n), 100) AS half FROM (SELECT DISTINCT node_type, label, n FROM long WHERE label IN (0, 1))
      GROUP BY node_type HAVING count(*) = 2),
    draws AS (
      SELECT s.node_type, s.label, i.idx, s.n FROM (SELECT DISTINCT node_type, label, n FROM long) s
      JOIN half USING (node_type), LATERAL (SELECT unnest(range(half))::INTEGER AS idx) i),
    placed AS (
      SELECT *, ('0x' || substr(md5('42:' || node_type || ':' || label || ':' || idx), 1, 15))::BIGINT % n AS place FROM draws)
    SELECT p.node_type, p.idx, d.text AS sentence, p.label
    FROM placed p JOIN long USING (node_type, label, place) JOIN documents d USING (doc_id)"""

DIFF_ROWS = f"""
    SELECT file, turn, code AS cleaned_code, {strip("code")} AS edited_code,
      {flat("code")} AS flattened_code, {flat(strip("code"))} AS flattened_edited_code
    FROM ({TURNS}) WHERE file = (SELECT file FROM ({longest(200)}))"""

TRAINING = f"""
    SELECT doc_id, pruning_type, {flat("cleaned_code")} AS source, {flat("edited_code")} AS target, kept AS label
    FROM ({DOCUMENT_PAIRS})"""

# Rounds in which every component takes its first edge outward; twelve are enough for 4 096 vectors.
_TREE_ROUND = """
f{i} AS MATERIALIZED (SELECT a.c AS c, min({{'w': s.w, 'u': s.u, 'v': s.v, 'o': b.c}}) AS e FROM s JOIN l{i} a ON a.p = s.x JOIN l{i} b ON b.p = s.y WHERE a.c <> b.c GROUP BY a.c),
r{i}(a, b) AS (SELECT c, c FROM f{i} UNION SELECT r{i}.a, g.y FROM r{i} JOIN (SELECT c AS x, e.o AS y FROM f{i} UNION SELECT e.o, c FROM f{i}) g ON r{i}.b = g.x),
l{n} AS MATERIALIZED (SELECT l{i}.p, m.c FROM l{i} JOIN (SELECT a, min(b) AS c FROM r{i} GROUP BY a) m ON l{i}.c = m.a)"""
REACHABILITY = (
    """WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id AS p, embedding::DOUBLE[] AS x FROM embeddings),
d AS MATERIALIZED (SELECT a.p AS u, b.p AS v, list_distance(a.x, b.x) AS d FROM v a, v b),
k AS MATERIALIZED (SELECT u AS p, d AS k FROM d QUALIFY row_number() OVER (PARTITION BY u ORDER BY d) = 5),
e AS MATERIALIZED (SELECT u, v, greatest(d, a.k, b.k) AS w FROM d JOIN k a ON a.p = u JOIN k b ON b.p = v WHERE u < v),
s AS MATERIALIZED (SELECT u, v, w, u AS x, v AS y FROM e UNION ALL SELECT u, v, w, v, u FROM e),
l0 AS (SELECT p, p AS c FROM v),"""
    + ",".join(_TREE_ROUND.format(i=i, n=i + 1) for i in range(12))
    + f"""
SELECT {rnd("e.w")} AS weight, count(*)::BIGINT AS n_edges FROM ({" UNION ".join(f"SELECT e.w AS w, e.u AS u, e.v AS v FROM f{i}" for i in range(12))}) e GROUP BY ALL"""
)

ORACLES: dict[str, str] = {
    # sources and sinks: what was written must come back
    "read_jsonl_partitions": """SELECT doc_id, text, source, n_chars, lang,
        CASE WHEN n_chars >= 1000 THEN 'train' ELSE 'test' END AS "partition" FROM documents""",
    "read_jsonl_partitions_some": """SELECT doc_id, text, source, n_chars, lang, 'train' AS "partition" FROM documents
        WHERE n_chars >= 1000 AND lang IN ('en', 'fr')""",
    "first_record_per_file_read": """SELECT doc_id, n_chars, text FROM documents
        QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) = 1""",
    "read_pair_dataset_some": f"""SELECT sha256(doc_id::VARCHAR) AS guid, {flat("cleaned_code")} AS source, {flat("edited_code")} AS target,
        kept AS label, lang, 'train' AS "partition", pruning_type FROM ({DOCUMENT_PAIRS})
        WHERE lang = 'en' AND doc_id % 2 = 0 AND pruning_type IN ('rule_point', 'back_seq')""",
    "read_pair_tree": f"""SELECT doc_id, cleaned_code, edited_code, kept AS cos_sim_diff_char, lang, 'train' AS "partition",
        pruning_type, 'programs.jsonl' AS file FROM ({DOCUMENT_PAIRS})""",
    "read_jsonl_tree": """SELECT doc_id, text, source, n_chars, lang,
        CASE WHEN n_chars >= 1000 THEN 'train' ELSE 'test' END AS "partition" FROM documents""",
    "read_jsonl_tree_filtered": """SELECT doc_id, text, source, n_chars, lang, 'train' AS "partition" FROM documents
        WHERE n_chars > 2000 AND lang IN ('en', 'fr')""",
    "read_pair_tree_filtered": f"""SELECT doc_id, cleaned_code, edited_code, kept AS cos_sim_diff_char, lang, 'train' AS "partition", pruning_type
        FROM ({DOCUMENT_PAIRS}) WHERE lang = 'en' AND pruning_type LIKE '%\\_seq' ESCAPE '\\'""",
    "tree_sizes": """SELECT lang, CASE WHEN n_chars >= 1000 THEN 'train' ELSE 'test' END AS "partition", count(*)::BIGINT AS n
        FROM documents GROUP BY ALL""",
    "read_selected_file": f"""
        WITH firsts AS (SELECT lang, source, {tokens("text")} AS n, length(text) AS c FROM documents
          QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) = 1)
        SELECT doc_id, n_chars, text FROM documents JOIN (SELECT lang, source FROM firsts WHERE c <= 20000 AND n <= 5000
          ORDER BY n DESC, 'lang=' || lang || '/source=' || source LIMIT 1) USING (lang, source)""",
    "write_pairs_counted": f"""SELECT 'python' AS lang, 'train' AS "partition", pruning_type, count(*)::BIGINT AS n_rows
        FROM ({DOCUMENT_PAIRS}) GROUP BY pruning_type""",
    "read_jsonl_dir": "SELECT doc_id, text, source, n_chars, lang FROM documents",
    "read_jsonl_file": "SELECT doc_id, text, source, n_chars, lang FROM documents",
    "read_nested_json": """SELECT item_id::VARCHAR AS filename, text AS original_code, length(text)::BIGINT AS num_of_nodes,
        len(string_split(text, chr(10)))::BIGINT AS n_edits, array_to_string(string_split(text, chr(10)), '|') AS edits FROM benchmark""",
    "read_labelled_csv": "SELECT text AS code, source AS label FROM documents",
    "read_pair_dataset": f"""SELECT sha256(doc_id::VARCHAR) AS guid, {flat("cleaned_code")} AS source, {flat("edited_code")} AS target,
        kept AS label, 'python' AS lang, 'train' AS "partition", pruning_type FROM ({DOCUMENT_PAIRS})""",
    "write_jsonl": """SELECT doc_id, text, source, n_chars, lang,
        CASE WHEN n_chars >= 1000 THEN 'train' ELSE 'test' END AS "partition" FROM documents""",
    "write_pairs": f"""SELECT sha256(doc_id::VARCHAR) AS guid, cleaned_code AS source, edited_code AS target, kept - 1 AS label, lang,
        'train' AS "partition", 'all_point' AS pruning_type FROM ({DOCUMENT_PAIRS})""",
    "write_report_csv": "SELECT lang, source, count(*)::BIGINT AS n_rows FROM documents GROUP BY lang, source",
    # projections and scalar functions
    "project_rename": """SELECT source AS repo, concat_ws('/', source, lang, doc_id) AS path, 'f' || doc_id AS func_name, lang, text FROM documents""",
    "strip_comments": f"SELECT doc_id, {strip('text')} AS text FROM documents",
    "strip_comments_code": f"""SELECT conv_id, turn, {strip('code')} AS code FROM (SELECT conv_id, turn,
        'x = "#' || role || '"' || chr(10) || '\"\"\"' || text || '\"\"\"' || chr(10) || '''''''' || text || ''''''' # ' || text
        || chr(10) || 'y = ' || turn || chr(10) || '\"\"\"' || text AS code FROM conversations)""",
    "flatten_ws": f"SELECT doc_id, {flat('text')} AS text FROM documents",
    "multi_hot": "SELECT user_id, day, "
    + ", ".join(f"list_contains(original, '{t}')::INTEGER AS {t}" for t in ("click", "error", "purchase", "signup", "view"))
    + f" FROM ({DAYS})",
    "label_encode": f"SELECT doc_id, node_type, CASE label WHEN 1 THEN 'POSITIVE' WHEN 0 THEN 'NEGATIVE' END AS name, label FROM ({LONG_LABELS})",
    "judge": f"""SELECT doc_id, CASE WHEN pred = quality THEN 'CORRECT' ELSE 'INCORRECT' END AS judge_text,
        (pred = quality)::INTEGER AS judge_int FROM ({PREDICTED})""",
    "make_pairs": f"""SELECT doc_id, 'index' AS guid, {flat("cleaned_code")} AS source, {flat("edited_code")} AS target, kept AS label
        FROM ({DOCUMENT_PAIRS})""",
    "make_pairs_ast": f"""SELECT doc_id, sha256(source || ':' || doc_id) AS guid, cleaned_code AS source, edited_code AS target, kept - 1 AS label
        FROM ({DOCUMENT_PAIRS})""",
    "edit_similarity_label": """SELECT l_orderkey, round_even((1 - d::DOUBLE / n) * (1 - d::DOUBLE / n) - 1, 3) + 0.0 AS label
        FROM (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS d FROM lineitem GROUP BY l_orderkey)""",
    "pooler_tag": f"SELECT doc_id, array_to_string(regexp_extract_all(path, '(cls|max|mean)'), '-') AS tag FROM ({MODEL_PATHS})",
    "pooler_name": f"SELECT doc_id, pooler FROM ({MODEL_PATHS})",
    "report_name": f"SELECT doc_id, 'run' || doc_id || '_back-seq-' || lang || '-' || source || '_' || pooler || '.csv' AS name FROM ({MODEL_PATHS})",
    "path_parts": """SELECT page_id, string_split(url, '/')[-2] AS dir, string_split(url, '/')[-1] AS file,
        string_split(string_split(url, '/')[-1], '.')[1] AS stem, replace(url, '/', '-') AS slug FROM pages""",
    "pair_key": "SELECT a.vec_id, a.label || '_' || b.label AS pair FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "cluster_name": "SELECT vec_id, CASE WHEN label = 0 THEN 'noise' ELSE 'cluster-' || (label - 1) END AS name FROM embeddings",
    "split_by_label": "SELECT doc_id, quality + 2 * toxic AS label FROM labels WHERE quality + 2 * toxic IN (0, 1)",
    "token_counts": f"SELECT doc_id, {tokens('text')} AS token_count FROM documents",
    "token_truncate": f"""SELECT doc_id, least(510, {tokens('text')})::INTEGER AS n_tokens,
        array_to_string(regexp_extract_all(text, '{TOKEN}')[1:510], ' ') AS tokens FROM documents""",
    "length_filter": f"SELECT doc_id, token_count FROM (SELECT *, {tokens('text')} AS token_count FROM documents) WHERE length(text) <= 800 AND token_count <= 510",
    "route_edits": f"SELECT user_id, day, original_code AS original, text, deleted AS delete_target_node, click, view, bucket FROM ({ROUTED}) WHERE bucket IS NOT NULL",
    "sym_diff": f"""SELECT user_id, day, array_to_string(list_sort(list_concat(
        list_filter(original, lambda x: NOT list_contains(edited, x)), list_filter(edited, lambda x: NOT list_contains(original, x)))), ',') AS diff
        FROM ({DAYS})""",
    # joins
    "cosine_all_pairs": f"""SELECT source_id, target_id, "index", source, target, {rnd("c")} AS "cosSim" FROM ({COSINES})""",
    "cosine_above_threshold": f"""SELECT source_id, target_id, "index", source, target, {rnd("c")} AS "cosSim" FROM ({COSINES}) WHERE c >= 0.3""",
    "cosine_top_k": f"""SELECT source_id, target_id, "index", source, target, {rnd("c")} AS "cosSim",
        row_number() OVER (PARTITION BY source_id ORDER BY {rnd("c", 12)} DESC, target_id)::INTEGER AS rank
        FROM ({COSINES}) WHERE source_id <> target_id QUALIFY rank <= 5""",
    "cosine_top_k_threshold": f"""SELECT source_id, target_id, "index", source, target, {rnd("c")} AS "cosSim",
        row_number() OVER (PARTITION BY source_id ORDER BY {rnd("c", 12)} DESC, target_id)::INTEGER AS rank
        FROM ({COSINES}) WHERE source_id <> target_id AND c >= 0.4 QUALIFY rank <= 3""",
    "fetch_selected_group": f"SELECT * FROM ({TURNS}) WHERE file = (SELECT file FROM ({longest(200)}))",
    "align_columns": f"""SELECT doc_id AS id, text AS code, lang AS label, {rnd("embedding[1]::DOUBLE")} AS first_value
        FROM documents JOIN embeddings ON doc_id = vec_id""",
    # aggregations
    "class_counts": f"""SELECT node_type, count(*) FILTER (label = 1)::BIGINT AS positive, count(*) FILTER (label = 0)::BIGINT AS negative
        FROM ({LONG_LABELS}) GROUP BY node_type""",
    "dataset_sizes": "SELECT lang, source, count(*)::BIGINT AS n_rows FROM documents GROUP BY lang, source",
    "confusion_counts": confusion(LONG_PREDICTED, "lang, node_type"),
    "binary_metrics": binary_from(LONG_PREDICTED, "node_type"),
    "latest_per_key": "SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1",
    "latest_checkpoint": """SELECT event_type || '_statement' AS node_type,
        'output/base_' || event_type || '_statement_' || user_id || '/checkpoint-' || event_id AS checkpoint, event_id AS step
        FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) = 1""",
    "first_record_per_file": FIRST_TURNS,
    "longest_within_limit": longest(200),
    "train_manifest": """SELECT n AS n_rows, ceil(n / 32.0)::BIGINT AS steps, ceil(ceil(n / 32.0) * 7 * 0.1::DOUBLE)::BIGINT AS warmup_steps
        FROM (SELECT count(*)::BIGINT AS n FROM documents)""",
    # sampling
    "balanced_sample": BALANCED,
    "sample_n": sampled("SELECT doc_id, lang, text FROM documents", "doc_id", 150),
    "sample_per_group": sampled("SELECT doc_id, lang, text FROM documents", "doc_id", 15, "lang"),
    "seeded_shuffle": shuffled("SELECT doc_id, text FROM documents", "doc_id", 32),
    # sets and reshaping
    "union_sets": """SELECT doc_id AS id, text FROM documents UNION ALL SELECT item_id, text FROM benchmark
        UNION ALL SELECT conv_id, text FROM conversations""",
    "melt_by_type": LONG_PREDICTED,
    "widen_by_type": "SELECT doc_id, "
    + ", ".join(
        f"""pred AS "{t}-inference", pred * 0.5::DOUBLE AS "{t}-score",
        CASE WHEN pred = {t} THEN 'CORRECT' ELSE 'INCORRECT' END AS "{t}-judge" """
        for t in ("quality", "toxic")
    )
    + f" FROM ({PREDICTED})",
    "explode_edits": f"SELECT filename, num, guid, source, target, label + 0.0 AS label FROM ({EDIT_LINES})",
    "nested_edit_chain": f"SELECT filename, num, guid, source, target, label + 0.0 AS label FROM ({EDIT_LINES})",
    "explode_edits_nested": f"""SELECT filename, count(*)::BIGINT AS n_pairs, string_agg(guid || '|' || target, chr(10) ORDER BY num) AS targets,
        {rnd("sum(label)", 3)} AS label_sum FROM ({EDIT_LINES}) GROUP BY filename""",
    # vectors
    "pool_vectors": f"""SELECT doc, dim, {rnd("cls")} AS cls, {rnd("max_")} AS "max", {rnd("mean")} AS mean FROM ({POOLED})""",
    "pool_matrix": f"""SELECT vec_id, d::INTEGER AS dim, {rnd("embedding[d + 1]::DOUBLE")} AS cls,
        {rnd("list_max([embedding[i * 8 + d + 1]::DOUBLE for i in range(1, 7)])")} AS "max",
        {rnd("list_avg([embedding[i * 8 + d + 1]::DOUBLE for i in range(1, 7)])")} AS mean
        FROM embeddings, (SELECT unnest(range(8)) AS d)""",
    "pool_concat": f"""SELECT doc, dim, {rnd("cls")} AS value FROM ({POOLED})
        UNION ALL SELECT doc, dim + (SELECT max(len(embedding)) FROM embeddings)::INTEGER, {rnd("mean")} FROM ({POOLED})""",
    "cosine_pairwise": f"""SELECT a.vec_id, {rnd("list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])")} AS inspect_mean
        FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "density_cluster": CLUSTERS,
    "reachability_tree": REACHABILITY,
    "pca_reduce": PRINCIPAL,
    "pca_reduce_wide": PRINCIPAL,
    "embedding_table": f"""SELECT vec_id, label, pc0, pc1, CASE WHEN cluster < 0 THEN 'noise' ELSE 'cluster-' || cluster END AS label_type
        FROM ({PRINCIPAL}) JOIN ({CLUSTERS}) USING (vec_id)""",
    # models
    "batch_embed": hashed("SELECT doc_id, text FROM documents", "text", "doc_id", 64),
    "batch_encode_tokens": f"""SELECT id, dim, {rnd("cls")} AS cls, {rnd("max_")} AS "max", {rnd("mean")} AS mean
        FROM ({digest_tokens("SELECT conv_id * 1000 + turn AS id, text FROM conversations", "text", "id", 8)})""",
    "embed_long": f"""
        WITH t AS (SELECT doc_id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos, len(toks) AS n
            FROM (SELECT doc_id, regexp_extract_all(text, '{TOKEN}') AS toks FROM documents)),
          b AS (SELECT doc_id, pos, n, d, (('0x' || substr(md5(tok), (2 * d + 1)::BIGINT, 2))::INTEGER - 127.5) / 127.5 AS x FROM t, (SELECT unnest(range(4)) AS d)),
          c AS (SELECT doc_id, pos, n, d, sum(x) OVER (PARTITION BY doc_id, d ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v FROM b)
        SELECT doc_id, d::INTEGER AS dim, {rnd("max(v) FILTER (pos = 1)")} AS cls, {rnd("max(v) FILTER (pos > 1 AND pos < n)")} AS "max",
          {rnd("avg(v) FILTER (pos > 1 AND pos < n)")} AS mean FROM c GROUP BY doc_id, d, n HAVING n > 2""",
    "inference_table": "SELECT doc_id, "
    + ", ".join(
        f"""({rule(c, s)} >= 0.5)::INTEGER AS "{t}-inference", {rnd(f"greatest({rule(c, s)}, 1 - {rule(c, s)})")} AS "{t}-score",
        CASE WHEN ({rule(c, s)} >= 0.5)::INTEGER = {t} THEN 'CORRECT' ELSE 'INCORRECT' END AS "{t}-judge" """
        for t, c, s in (("quality", "500", "200"), ("toxic", "5000", "900"))
    )
    + f" FROM ({sampled(SAMPLE_ROWS, 'doc_id', 60)})",
    "embedding_cosines": f"""
        WITH pooled AS MATERIALIZED (
          SELECT item_id, list(max_::FLOAT::DOUBLE ORDER BY dim) AS v
          FROM ({digest_tokens("SELECT item_id, text FROM benchmark", "text", "item_id", 8)}) GROUP BY item_id)
        SELECT a.item_id || '_' || b.item_id AS "index", a.item_id AS source, b.item_id AS target,
          {rnd("list_cosine_similarity(a.v, b.v)")} AS "cosSim" FROM pooled a, pooled b""",
    "batch_classify": "SELECT doc_id, "
    + ", ".join(
        f"""({rule(c, s)} >= 0.5)::INTEGER AS "{t}-inference", {rnd(f"greatest({rule(c, s)}, 1 - {rule(c, s)})")} AS "{t}-score" """
        for t, c, s in (("quality", "500", "200"), ("toxic", "5000", "900"))
    )
    + " FROM documents",
    # the three chains
    "subtree_report": binary_from(_sample_predictions(), "node_type"),
    "edit_report": binary_from(_edit_predictions(), "bucket, node_type"),
    "diff_metric_report": f"""
        WITH rows AS MATERIALIZED ({DIFF_ROWS})
        SELECT rows.*, {rnd("a.c")} AS inspect_cls, {rnd("b.c")} AS inspect_mean FROM rows
        JOIN ({hashed_cosine("FROM rows", "turn", "flattened_code", "flattened_edited_code", 32)}) a USING (turn)
        JOIN ({hashed_cosine("FROM rows", "turn", "flattened_code", "flattened_edited_code", 64)}) b USING (turn)""",
    "training_set": shuffled(sampled(TRAINING, "doc_id", 50, "pruning_type"), "doc_id", 2),
}
