"""The same results as SQL over the given tables, for DuckDB.

Written from the meaning of each query, not from its Spark form: parent rows,
pairs and windows are joins and window functions here.
"""

import re

from knowspark.operators.vector_index import BITS, differing

_VIEWS = {
    "thoughts": r"""
SELECT 'd'||doc_id AS id, replace(text, chr(10), chr(10)||chr(10)) AS content, e.embedding,
       CASE doc_id % 3 WHEN 0 THEN 'note' WHEN 1 THEN 'thought' ELSE 'event' END AS content_type,
       CASE WHEN doc_id % 4 <> 0 THEN 'Doc '||doc_id END AS title,
       ['topic-'||(doc_id % 12), lang, source] AS tags, source,
       TIMESTAMP '2024-01-01' + to_minutes(doc_id*37) AS created_at
FROM documents LEFT JOIN embeddings e ON e.vec_id % 4 = 0 AND e.vec_id // 4 = doc_id""",
    "tasks": r"""
SELECT 't'||o_orderkey AS id, 'Order '||o_orderkey AS title,
       CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS notes,
       CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' ELSE 'cancelled' END AS status,
       CASE substr(o_orderpriority,1,1) WHEN '1' THEN 'high' WHEN '2' THEN 'high'
            WHEN '3' THEN 'medium' ELSE 'low' END AS priority,
       CASE WHEN o_orderkey % 10 <> 0 THEN CAST(o_orderdate AS DATE) END AS due_date,
       CAST(CASE o_orderkey % 5 WHEN 0 THEN 7 WHEN 1 THEN 30 END AS INTEGER) AS recurrence_days,
       CASE o_orderkey % 6 WHEN 0 THEN 'general' WHEN 1 THEN 'work' WHEN 2 THEN 'personal'
            WHEN 3 THEN 'health' WHEN 4 THEN 'finance' ELSE 'home' END AS category,
       ['topic-'||(o_orderkey % 12), 'clerk-'||(o_custkey % 7)] AS tags, e.embedding,
       o_orderdate AS created_at
FROM orders LEFT JOIN embeddings e ON e.vec_id % 4 = 1 AND e.vec_id // 4 = o_orderkey""",
    "contacts": r"""
SELECT 'c'||c_custkey AS id, c_name AS name,
       CASE WHEN c_custkey % 5 <> 0 THEN 'c'||c_custkey||'@example.org' END AS email,
       CAST(NULL AS VARCHAR) AS phone, c_mktsegment AS company,
       CASE WHEN c_mktsegment <> 'BUILDING' THEN l.last_contact_at END AS last_contact_at,
       CASE WHEN c_custkey % 2 = 0 THEN 'segment '||c_mktsegment END AS notes,
       ['topic-'||(c_custkey % 12), lower(c_mktsegment)] AS tags, e.embedding,
       TIMESTAMP '1995-01-01' + to_minutes(c_custkey) AS created_at
FROM customer
LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last_contact_at FROM orders
           GROUP BY o_custkey) l ON l.o_custkey = c_custkey
LEFT JOIN embeddings e ON e.vec_id % 4 = 2 AND e.vec_id // 4 = c_custkey""",
    "home_items": r"""
SELECT 'h'||p_partkey AS id, p_name AS name,
       CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS notes, l.last_done_at,
       CASE WHEN p_size % 7 <> 0 THEN l.last_done_at + to_days(p_size) END AS next_due_at,
       CASE WHEN p_size % 7 <> 0 THEN p_size END AS interval_days,
       ['topic-'||(p_partkey % 12), lower(p_type)] AS tags, e.embedding,
       TIMESTAMP '1995-01-01' + to_minutes(p_partkey) AS created_at
FROM part
LEFT JOIN (SELECT l_partkey, max(l_shipdate) AS last_done_at FROM lineitem GROUP BY l_partkey) l
       ON l.l_partkey = p_partkey
LEFT JOIN embeddings e ON e.vec_id % 4 = 3 AND e.vec_id // 4 = p_partkey""",
    "items": r"""
SELECT id, content, title, tags, content_type, created_at, embedding FROM thoughts
UNION ALL SELECT id, CASE WHEN notes IS NOT NULL THEN title||chr(10)||notes ELSE title END, title,
       tags, 'task', created_at, embedding FROM tasks
UNION ALL SELECT id, CASE WHEN notes IS NOT NULL THEN name||chr(10)||notes ELSE name END, name,
       tags, 'contact', created_at, embedding FROM contacts
UNION ALL SELECT id, CASE WHEN notes IS NOT NULL THEN name||chr(10)||notes ELSE name END, name,
       tags, 'home_item', created_at, embedding FROM home_items""",
    "item_tags": r"""SELECT id, tags, embedding, unnest(tags) AS tag FROM items""",
    "chunk_rows": r"""
SELECT 'v'||conv_id||'-'||turn AS id, text AS content, 'note' AS content_type,
       'Conversation '||conv_id AS title, [role] AS tags, CAST(turn AS INTEGER) AS chunk_index,
       CASE WHEN turn > 0 THEN 'v'||conv_id||'-0' END AS parent_id,
       TIMESTAMP '2024-01-01' + to_minutes(conv_id * 10 + turn) AS created_at
FROM conversations""",
    "entries": r"""
SELECT id AS entry_id, content,
       CASE WHEN CAST(substr(id, 2) AS BIGINT) % 9 = 8 THEN 'task' ELSE content_type END
       AS content_type, title, tags, source, '{"doc_id":'||substr(id, 2)||'}' AS metadata, created_at
FROM thoughts""",
    "interactions": r"""
SELECT event_id, 'c'||user_id AS contact_id, ts, event_type||' '||CAST(value AS VARCHAR) AS note
FROM events""",
    "logged_lines": r"""
SELECT contact_id, string_agg(strftime(ts, '%Y-%m-%d %H:%M UTC')||': '||note,
       chr(10)||chr(10) ORDER BY ts, event_id) AS lines, max(ts) AS last
FROM interactions GROUP BY contact_id""",
    "logged": r"""
SELECT id, CASE WHEN lines IS NULL THEN notes WHEN notes IS NULL OR notes = '' THEN lines
                ELSE notes||chr(10)||chr(10)||lines END AS notes,
       coalesce(last, last_contact_at) AS last_contact_at, coalesce(last, created_at) AS updated_at
FROM contacts LEFT JOIN logged_lines ON contact_id = id""",
    "note_parts": r"""
SELECT id, place, trim(part, {js}) AS part,
       regexp_matches(trim(part, {js}), {re}, 's') AS hit
FROM (SELECT id, unnest(string_split_regex(notes, '\n\n+')) AS part,
             generate_subscripts(string_split_regex(notes, '\n\n+'), 1) AS place FROM logged)
WHERE trim(part, {js}) <> ''""",
    "note_hits": r"""
SELECT id, place, regexp_extract(part, {re}, 1, 's') AS date,
       trim(regexp_extract(part, {re}, 2, 's'), {js}) AS content,
       row_number() OVER (PARTITION BY id ORDER BY regexp_extract(part, {re}, 1, 's') DESC, place)
       - 1 AS seq
FROM note_parts WHERE hit""",
    "task_changes": r"""
SELECT 't'||l_orderkey AS id,
       {shipped} * 100000000000000 + l_partkey * 10000000 + l_suppkey * 10 + l_linenumber
       AS version,
       CASE WHEN l_returnflag = 'R' THEN 'Returned '||l_partkey END AS title,
       CASE WHEN l_linestatus = 'F' THEN l_returnflag||' '||l_partkey END AS notes,
       CASE WHEN l_linestatus = 'F' THEN 'done' END AS status,
       CASE WHEN l_quantity > 40 THEN 'high' WHEN l_quantity < 5 THEN 'low' END AS priority,
       CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_shipdate AS DATE) END AS due_date,
       CASE WHEN l_returnflag = 'A' THEN ['returned', l_linestatus] END AS tags
FROM lineitem""",
    "task_news": r"""
SELECT id, {news} FROM task_changes GROUP BY id""",
    "updated": r"""
SELECT t.id, coalesce(n.title, t.title) AS title, coalesce(n.notes, t.notes) AS notes,
       coalesce(n.status, t.status) AS status, coalesce(n.priority, t.priority) AS priority,
       coalesce(n.due_date, t.due_date) AS due_date, category,
       coalesce(n.tags, t.tags) AS tags,
       coalesce(n.title, n.notes, n.status, n.priority, CAST(n.due_date AS VARCHAR),
                CAST(n.tags AS VARCHAR)) IS NOT NULL AS touched,
       n.title IS NOT NULL OR n.notes IS NOT NULL AS text_given, created_at
FROM tasks t LEFT JOIN task_news n USING (id)""",
    "completions": r"""
SELECT DISTINCT l_orderkey||'-'||l_linenumber||'-'||l_partkey AS event_id, 't'||l_orderkey AS id
FROM lineitem""",
    "spawned": r"""
SELECT {uuid} AS id, title, notes, 'open' AS status, priority,
       due_date + CAST(recurrence_days AS INTEGER) AS due_date, recurrence_days, category, tags
FROM (SELECT *, md5(c.event_id||':'||t.id||':next') AS h FROM tasks t JOIN completions c USING (id)
      WHERE t.recurrence_days <> 0 AND t.due_date IS NOT NULL)""",
    "paragraphs": r"""
SELECT id, place, trim(part, {py}) AS text, row_number() OVER (PARTITION BY id ORDER BY place) - 1
       AS chunk_index, count(*) OVER (PARTITION BY id) AS total_chunks
FROM (SELECT id, unnest(string_split(content, chr(10)||chr(10))) AS part,
             generate_subscripts(string_split(content, chr(10)||chr(10)), 1) AS place FROM noted)
WHERE length(trim(part, {py})) >= 50""",
    "noted_words": r"""
SELECT id, word, row_number() OVER (PARTITION BY id ORDER BY place) - 1 AS n,
       count(*) OVER (PARTITION BY id) AS total
FROM (SELECT id, unnest(string_split_regex(content, '{ws}')) AS word,
             generate_subscripts(string_split_regex(content, '{ws}'), 1) AS place
      FROM noted WHERE id NOT IN (SELECT id FROM paragraphs))
WHERE word <> ''""",
    "windows": r"""
SELECT id, w AS chunk_index, string_agg(word, ' ' ORDER BY n) AS text
FROM noted_words, (SELECT unnest(range(0, 1000)) AS w)
WHERE total > 500 AND n >= w * 450 AND n < w * 450 + 500 AND (w = 0 OR (w - 1) * 450 + 500 < total)
GROUP BY id, w""",
    "chunks": r"""
SELECT id, chunk_index, total_chunks, text FROM paragraphs
UNION ALL SELECT id, chunk_index, count(*) OVER (PARTITION BY id), text FROM windows
UNION ALL SELECT id, 0, 1, trim(content, {py}) FROM noted
WHERE id NOT IN (SELECT id FROM paragraphs) AND id NOT IN (SELECT id FROM windows)
UNION ALL SELECT id, 0, 1, content FROM other""",
    "query_vectors": r"""
SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings""",
    "centroids": r"""
SELECT tag, max(n) AS n, list(mean ORDER BY dim) AS centroid, dims FROM (
  SELECT tag, dim, avg(v) AS mean, count(*) AS n, count(*) OVER (PARTITION BY tag) AS dims
  FROM (SELECT tag, unnest(CAST(embedding AS DOUBLE[])) AS v,
               generate_subscripts(embedding, 1) - 1 AS dim
        FROM (SELECT DISTINCT id, tag, embedding FROM item_tags WHERE embedding IS NOT NULL))
  GROUP BY tag, dim) GROUP BY tag, dims""",
}

_CODES_PY = [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
             0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_CODES_JS = [c for c in _CODES_PY if c not in (28, 29, 30, 31, 0x85)] + [0xFEFF]
_WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"
_JS_WS = r"[\s\x0b\p{Z}\x{feff}]+"
_RE = r"'^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}(?::\d{2})? UTC): (.*)$'"


def _chars(codes) -> str:
    return "(" + "||".join(f"chr({c})" for c in codes) + ")"


def _uuid(h: str = "h") -> str:
    return (f"substr({h},1,8)||'-'||substr({h},9,4)||'-'||substr({h},13,4)||'-'||"
            f"substr({h},17,4)||'-'||substr({h},21,12)")


_NEWS = ", ".join(
    f"arg_max({c}, version) FILTER ({c} IS NOT NULL) AS {c}"
    for c in ("title", "notes", "status", "priority", "due_date", "tags"))

_SHIPPED = "CAST(date_diff('day', TIMESTAMP '1995-01-01', l_shipdate) AS BIGINT)"
_FILL = {"{shipped}": _SHIPPED, "{js}": _chars(_CODES_JS), "{py}": _chars(_CODES_PY), "{re}": _RE, "{ws}": _WS,
         "{jsws}": _JS_WS, "{news}": _NEWS, "{uuid}": _uuid()}


def _fill(sql: str) -> str:
    for key, value in _FILL.items():
        sql = sql.replace(key, value)
    return sql


def _with(body: str, **extra: str) -> str:
    """Puts the views a query needs before it, each after those it reads."""
    views = {**_VIEWS, **extra}
    placed = []

    def place(sql, own=None):
        for name in views:
            if name != own and name not in placed and re.search(rf"\b{name}\b", sql):
                place(views[name], name)
                placed.append(name)

    place(body)
    ctes = ",\n".join(f"{n} AS ({views[n]})" for n in placed)
    if ctes and body.lstrip().startswith("WITH "):
        return _fill(f"WITH {ctes},\n{body.lstrip().removeprefix('WITH ')}")
    return _fill(f"WITH {ctes}\n{body}" if ctes else body)


def iso(expr: str, name: str = None) -> str:
    text = (f"strftime({expr}, '%Y-%m-%dT%H:%M:%S')||CASE WHEN epoch_us({expr}) % 1000000 = 0 "
            f"THEN '' ELSE strftime({expr}, '.%f') END||'+00:00'")
    return f"{text} AS {name or expr}"


def tag_text(expr: str = "tags") -> str:
    return f"array_to_string({expr}, '|') AS tags"


_ITEM = f"id, content, title, {tag_text()}, content_type, {iso('created_at')}"
_THOUGHT = f"id, content, title, {tag_text()}, content_type, source, {iso('created_at')}"
_TASK = (f"CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS priority_rank, id, "
         f"title, notes, status, priority, CAST(due_date AS VARCHAR) AS due_date, recurrence_days, "
         f"category, {tag_text()}, {iso('created_at')}")
_CONTACT = (f"id, name, email, phone, company, {iso('last_contact_at')}, notes, {tag_text()}, "
            f"{iso('created_at')}")
_HOME = (f"id, name, notes, {iso('last_done_at')}, {iso('next_due_at')}, interval_days, "
         f"{tag_text()}, {iso('created_at')}")
_STATE = (f"id, title, notes, status, priority, CAST(due_date AS VARCHAR) AS due_date, category, "
          f"{tag_text()}")
_D = "DATE '2001-07-20'"
_T = "TIMESTAMP '2001-07-20'"
_REVIEW = "FROM thoughts WHERE created_at >= TIMESTAMP '2024-01-12' - INTERVAL 7 DAY"
_NOT_SINCE = "last_contact_at IS NULL OR last_contact_at < {} - INTERVAL {} DAY"
_NOTED = {"noted": "SELECT id, content FROM thoughts WHERE content_type = 'note'",
          "other": "SELECT id, content FROM thoughts WHERE content_type <> 'note'"}
_ALL_NOTED = {"noted": "SELECT id, content FROM thoughts",
              "other": "SELECT id, content FROM thoughts WHERE false"}
_VALID = "content_type IN ('thought', 'note', 'event') AND length(content) BETWEEN 1 AND 50000"
_ENTRY_NOTED = {
    "noted": f"SELECT entry_id AS id, content FROM entries WHERE content_type = 'note' AND {_VALID}",
    "other": f"SELECT entry_id AS id, content FROM entries WHERE content_type <> 'note' AND {_VALID}"}
_LONG = r"SELECT 'd'||doc_id AS id, regexp_replace(text, '[ \n]+', chr(10)||chr(10), 'g') AS content FROM documents"


def _top(select: str, source: str, order: str, n: int) -> str:
    return (f"SELECT rank, {select} FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS rank "
            f"FROM {source}) WHERE rank <= {n}")


def _nearest(source: str, vec_id: int, select: str, n: int, where: str = "true") -> str:
    return (f"SELECT {select} FROM (SELECT *, row_number() OVER (ORDER BY similarity DESC, id) AS "
            f"rank FROM (SELECT s.*, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) AS "
            f"similarity FROM {source} s, query_vectors WHERE query_id = {vec_id} AND embedding IS "
            f"NOT NULL AND {where})) WHERE rank <= {n}")


def _ago(minutes: str, months: bool) -> str:
    days = (f"WHEN {minutes} // 1440 < 30 THEN ({minutes} // 1440)||'d' "
            f"ELSE ({minutes} // 1440 // 30)||'mo'" if months else f"ELSE ({minutes} // 1440)||'d'")
    return (f"CASE WHEN {minutes} < 1 THEN 'just now' WHEN {minutes} < 60 THEN {minutes}||'m' "
            f"WHEN {minutes} // 60 < 24 THEN ({minutes} // 60)||'h' {days} END")


def _reasons(*rules) -> str:
    parts = ", ".join(f"CASE WHEN {bad} THEN '{why}' END" for bad, why in rules)
    return f"concat_ws('; ', {parts}) AS reasons"


def _text_rules(column: str, maximum: int):
    return [(f"{column} IS NULL", f"{column} is missing"),
            (f"length({column}) < 1", f"{column} is empty"),
            (f"length({column}) > {maximum}", f"{column} is too long")]


def _norm(expr: str) -> str:
    return f"substr(regexp_replace(lower({expr}), '[^a-z0-9_-]', '', 'g'), 1, 40)"


def _clean(words: str, cap: int) -> str:
    """First occurrences of the normalised words, by key ``k``; ``words`` yields (k, place, raw)."""
    return (f"SELECT k, string_agg(tag, '|' ORDER BY place) AS tags FROM (SELECT *, row_number() "
            f"OVER (PARTITION BY k ORDER BY place) AS n FROM (SELECT k, {_norm('raw')} AS tag, "
            f"min(place) AS place FROM ({words}) GROUP BY k, tag) WHERE tag <> '') WHERE n <= {cap} "
            f"GROUP BY k")


_INGESTED = (
    f"SELECT CASE WHEN chunk_index = 0 THEN {_uuid('h0')} ELSE {_uuid('h')} END AS id, "
    f"CASE WHEN chunk_index > 0 THEN {_uuid('h0')} END AS parent_id, chunk_index, content, "
    f"content_type, title, {tag_text()}, source, metadata, {iso('created_at')}{{more}} FROM ("
    f"SELECT e.* EXCLUDE (content), c.text AS content, c.chunk_index, "
    f"md5(entry_id||':'||c.chunk_index) AS h, md5(entry_id||':0') AS h0 "
    f"FROM entries e JOIN chunks c ON c.id = e.entry_id)")

_HOME_DAYS = ("CAST(ceil((epoch_us(next_due_at) - epoch_us(TIMESTAMP '2001-07-20 06:00:00')) "
              "/ 86400000000.0) AS BIGINT)")
_LAST_DAYS = f"CAST(floor((epoch_us({_T}) - epoch_us(last_contact_at)) / 86400000000.0) AS BIGINT)"


def _activity(step_days: int, slides: int, closed: str) -> str:
    return f"""
SELECT {iso('w', '"start"')}, {iso(f'w + INTERVAL {slides} DAY', '"end"')}, facet, value,
       count(*) AS n
FROM (SELECT date_trunc('day', created_at) - to_days(CAST(s AS INTEGER)) AS w, facet, value
      FROM (SELECT created_at, 'type' AS facet, content_type AS value FROM thoughts
            UNION ALL SELECT created_at, 'tag', unnest(tags) FROM thoughts),
           (SELECT unnest(range(0, {slides}, {step_days})) AS s)) {closed}
GROUP BY w, facet, value"""


#: Columns that Spark counts in 32 bits.
_INTEGERS = {
    **dict.fromkeys(("recent", "recent_events", "by_any_tag", "by_date_range", "related_tags",
                     "related_all", "review_top_tags", "search", "search_tasks",
                     "search_thoughts", "search_pct", "suggested", "search_batch", "search_pruned",
                     "search_batch_items", "suggest_all", "search_approx", "search_wide",
                     "search_batch_wide", "suggest_wide", "tag_page"),
                    ("rank",)),
    **dict.fromkeys(("chunk_all", "chunk_notes", "chunk_sliding", "chunk_windows"),
                    ("chunk_index", "total_chunks")),
    **dict.fromkeys(("ingest_rows", "stream_ingest"), ("chunk_index",)),
    "ingest_summary": ("chunks_created",),
    "validate_entries": ("n",),
}


def _build() -> dict:
    q = {}
    counts = "SELECT tag, count(*) AS count FROM item_tags GROUP BY tag"
    pairs = ("SELECT a.tag, b.tag AS related, count(*) AS co_occurrence FROM (SELECT DISTINCT id, "
             "tag FROM item_tags) a JOIN item_tags b ON a.id = b.id AND a.tag <> b.tag "
             "GROUP BY a.tag, b.tag")

    # sources
    q["store_round_trip"] = _with(" UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", id, {a} AS first, {b} AS second, {tag_text()}, "
        f"{iso('created_at')}, CAST(len(embedding) AS INTEGER) AS dims, "
        f"round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM {t}"
        for t, a, b in (("thoughts", "content", "title"), ("tasks", "title", "notes"),
                        ("contacts", "name", "notes"), ("home_items", "name", "notes"))))
    q["read_notes"] = _with("""
        SELECT md5(content) AS digest, CAST(length(content) AS INTEGER) AS n, 'note' AS content_type,
               'api' AS source, '' AS tags
        FROM (SELECT trim(string_agg(text, chr(10) ORDER BY doc_id), {js}) AS content
              FROM documents GROUP BY lang, source) WHERE content <> ''""")
    q["read_nameless_entries"] = _with("""
        SELECT content_type, count(*) AS n, count(*) AS ids
        FROM (SELECT content_type FROM entries UNION ALL
              SELECT content_type FROM entries WHERE length(content) % 3 = 0) GROUP BY content_type""")
    q["parse_iso"] = f"SELECT event_id, {iso('ts')} FROM events"
    q["get_rows"] = _with(f"SELECT {_TASK} FROM tasks WHERE id IN ('t1', 't7', 't32')")
    q["validate_updates"] = _with("SELECT id, version, " + _reasons(
        ("length(title) < 1", "title is empty"), ("length(title) > 500", "title is too long"),
        ("status NOT IN ('open', 'done', 'cancelled')", "status is not allowed"),
        ("priority NOT IN ('high', 'medium', 'low')", "priority is not allowed"))
        + " FROM (SELECT * REPLACE (CASE WHEN version % 11 = 0 THEN '' ELSE title END AS title) "
        "FROM task_changes)")
    q["read_entries"] = _with(
        f"SELECT entry_id, content, content_type, title, {tag_text()}, source, metadata FROM entries")
    by_tag = f"SELECT {_ITEM} FROM items WHERE list_contains(tags, 'topic-3')"
    q["items_by_tag_index"] = _with(by_tag)

    # ingest
    q["validate_entries"] = _with("SELECT entry_id, length(content) AS n, content_type, " + _reasons(
        *_text_rules("content", 50000),
        ("content_type NOT IN ('thought', 'note', 'event')", "content_type is not allowed"))
        + " FROM entries")
    q["validate_tasks"] = ("SELECT id, " + _reasons(
        *_text_rules("title", 500),
        ("status NOT IN ('open', 'done', 'cancelled')", "status is not allowed"),
        ("priority NOT IN ('high', 'medium', 'low')", "priority is not allowed"))
        + """ FROM (SELECT 't'||o_orderkey AS id,
        CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 13 = 0 THEN repeat('x', 501)
             WHEN o_orderkey % 17 <> 0 THEN 'Order '||o_orderkey END AS title,
        CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' ELSE o_orderstatus END AS status,
        lower(substr(o_orderpriority, 3)) AS priority FROM orders)""")
    q["validate_contacts"] = "SELECT id, " + _reasons(*_text_rules("name", 200)) + """
        FROM (SELECT 'c'||c_custkey AS id, CASE WHEN c_custkey % 11 = 0 THEN ''
              WHEN c_custkey % 13 = 0 THEN repeat(c_name, 12) ELSE c_name END AS name FROM customer)"""
    q["validate_home"] = "SELECT id, " + _reasons(*_text_rules("name", 300)) + """
        FROM (SELECT 'h'||p_partkey AS id, CASE WHEN p_partkey % 11 = 0 THEN ''
              WHEN p_partkey % 13 = 0 THEN repeat(p_name, 40) ELSE p_name END AS name FROM part)"""
    q["validate_interactions"] = _with("SELECT event_id, " + _reasons(*_text_rules("note", 5000)) + """
        FROM (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN ''
              WHEN event_id % 17 = 0 THEN repeat(note, 900)
              WHEN event_id % 19 <> 0 THEN note END AS note FROM interactions)""")
    q["apply_defaults"] = """SELECT 't'||o_orderkey AS id,
        CASE o_orderstatus WHEN 'F' THEN 'done' ELSE 'open' END AS status,
        CASE WHEN o_orderpriority = '1-URGENT' THEN 'high' ELSE 'medium' END AS priority,
        'general' AS category, 0 AS n_tags FROM orders"""
    chunked = "SELECT id, chunk_index, total_chunks, text FROM chunks"
    q["chunk_all"] = _with(chunked, **_NOTED)
    q["chunk_notes"] = _with(chunked, **_ALL_NOTED)
    q["chunk_sliding"] = _with(chunked, noted=_LONG, other="SELECT id, content FROM noted WHERE false")
    q["chunk_windows"] = _with("""
        SELECT id, chunk_index, count(*) OVER (PARTITION BY id) AS total_chunks, text FROM (
          SELECT id, w AS chunk_index, string_agg(word, ' ' ORDER BY n) AS text
          FROM all_words, (SELECT unnest(range(0, 2000)) AS w)
          WHERE n >= w * 90 AND n < w * 90 + 120 AND (w = 0 OR (w - 1) * 90 + 120 < total)
          GROUP BY id, w)""",
        noted=_LONG, all_words=r"""
        SELECT id, word, row_number() OVER (PARTITION BY id ORDER BY place) - 1 AS n,
               count(*) OVER (PARTITION BY id) AS total
        FROM (SELECT id, unnest(string_split_regex(content, '{ws}')) AS word,
                     generate_subscripts(string_split_regex(content, '{ws}'), 1) AS place FROM noted)
        WHERE word <> ''""")
    q["ingest_rows"] = _with(_INGESTED.replace("{more}", ""), **_ENTRY_NOTED)
    q["stream_ingest"] = _with(_INGESTED.replace("{more}", ", 64 AS dims"), **_ENTRY_NOTED)
    q["ingest_summary"] = _with(
        "SELECT entry_id, content_type, total_chunks AS chunks_created FROM entries JOIN chunks "
        "ON id = entry_id WHERE chunk_index = 0", **_ENTRY_NOTED)
    q["ingest_totals"] = _with(
        "SELECT count(DISTINCT id) AS total_entries, count(*) AS total_chunks FROM chunks",
        **_ENTRY_NOTED)
    q["hash_embed"] = _with(r"""
        SELECT id, bucket, round(CAST(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS FLOAT)
               AS DOUBLE), 6) AS weight
        FROM (SELECT id, CAST(CAST('0x'||substr(md5(word), 1, 8) AS BIGINT) % 384 AS INTEGER) AS
                     bucket, CAST(count(*) AS DOUBLE) AS n
              FROM (SELECT id, unnest(string_split_regex(lower(content), '{ws}')) AS word
                    FROM thoughts) WHERE word <> '' GROUP BY ALL)""")
    q["vector_text"] = """SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dims, true AS same,
        round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM embeddings"""
    q["json_field"] = """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
        FROM events"""
    raw = ("SELECT p_partkey AS k, unnest([p_name, p_brand, '#'||p_name, p_type, 'Size '||p_size, "
           "'!', p_type||'_'||p_size, 'p-'||p_partkey]) AS raw, unnest(range(0, 8)) AS place "
           "FROM part")
    q["refine_post"] = f"""SELECT p_partkey,
        CASE WHEN p_partkey % 10 = 0 THEN '' ELSE p_name END AS content,
        CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS title, tags,
        CASE WHEN p_partkey % 10 = 0 THEN 'the refiner gave no content' END AS error
        FROM part JOIN ({_clean(raw, 5)}) ON k = p_partkey"""
    q["refine_identity"] = _with("""SELECT entry_id, trim(content, {py}) AS content,
        CAST(NULL AS VARCHAR) AS title, '' AS tags,
        CASE WHEN trim(content, {py}) = '' THEN 'the refiner gave no content' END
        AS refine_error FROM entries""")

    q["refine_batches"] = _with("""
        SELECT entry_id, CASE WHEN known THEN text END AS content,
               CASE WHEN known THEN nullif(trim(substr(split_part(text, chr(10), 1), 1, 60), {py}), '') END
                 AS title,
               CASE WHEN known THEN content_type ELSE '' END AS tags,
               CASE WHEN NOT known THEN 'the refiner failed: unknown type'
                    WHEN text = '' THEN 'the refiner gave no content' END AS refine_error
        FROM (SELECT entry_id, trim(content, {py}) AS text, content_type,
                     content_type IN ('thought', 'note', 'event') AS known FROM entries)""")

    # filters and lists
    newest = "created_at DESC, id"
    q["recent"] = _with(_top(_THOUGHT, "thoughts", newest, 10))
    q["recent_events"] = _with(
        _top(_THOUGHT, "thoughts WHERE content_type = 'event'", newest, 25))
    q["by_any_tag"] = _with(
        _top(_THOUGHT, "thoughts WHERE list_has_any(tags, ['topic-3', 'de'])", newest, 20))
    q["by_date_range"] = _with(_top(
        _THOUGHT, "thoughts WHERE created_at BETWEEN TIMESTAMP '2024-01-01 12:20:00' AND "
        "TIMESTAMP '2024-01-03 12:00:00'", newest, 100))
    q["unified_items"] = _with(f"SELECT {_ITEM} FROM items")
    q["items_by_tag"] = _with(by_tag)
    q["items_by_type"] = _with("""SELECT content_type, count(*) AS n, CAST(list_position(
        ['thought', 'note', 'event', 'task', 'contact', 'home_item'], content_type) - 1 AS INTEGER)
        AS position FROM items WHERE list_contains(tags, 'topic-3') GROUP BY content_type""")
    q["display_text"] = _with(
        "SELECT id, CASE WHEN title <> '' THEN title ELSE coalesce(content, '') END AS text FROM items")
    q["list_tasks"] = _with(f"SELECT {_TASK} FROM tasks")
    numbered = "row_number() OVER (ORDER BY {}) AS rank"
    q["list_tasks_ranked"] = _with(
        "SELECT id, priority, CAST(due_date AS VARCHAR) AS due_date, " + numbered.format(
            "CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, due_date NULLS LAST, "
            "created_at DESC, id") + " FROM tasks")
    q["list_contacts_ranked"] = _with(
        f"SELECT id, {iso('last_contact_at')}, " + numbered.format(
            "last_contact_at NULLS FIRST, name, id") + " FROM contacts")
    q["list_home_ranked"] = _with(
        f"SELECT id, {iso('next_due_at')}, " + numbered.format("next_due_at NULLS LAST, name, id")
        + " FROM home_items")
    q["items_by_tag_ranked"] = _with(
        f"SELECT {_ITEM}, " + numbered.format("items.created_at DESC, id")
        + " FROM items WHERE list_contains(tags, 'topic-3')")
    q["review_entries_ranked"] = _with(
        f"SELECT {_ITEM}, " + numbered.format("thoughts.created_at DESC, id") + f" {_REVIEW}")
    q["list_tasks_due"] = _with(
        f"SELECT {_TASK} FROM tasks WHERE status = 'open' AND category = 'work' "
        f"AND due_date <= {_D} + 7")
    q["list_contacts"] = _with(
        f"SELECT {_CONTACT} FROM contacts WHERE {_NOT_SINCE.format(_T, 30)}")
    q["list_home"] = _with(
        f"SELECT {_HOME} FROM home_items WHERE next_due_at <= {_T} + INTERVAL 7 DAY")
    sections = {
        "overdue_tasks": ("tasks", f"status = 'open' AND due_date < {_D}"),
        "due_soon_tasks": (
            "tasks", f"status = 'open' AND due_date >= {_D} AND due_date <= {_D} + 7"),
        "overdue_home": ("home_items", f"next_due_at < {_T}"),
        "due_soon_home": (
            "home_items", f"next_due_at >= {_T} AND next_due_at <= {_T} + INTERVAL 7 DAY"),
        "contacts_to_reach": ("contacts", _NOT_SINCE.format(_T, 14)),
    }
    shape = {"tasks": _TASK, "home_items": _HOME, "contacts": _CONTACT}
    keys = {"tasks": "title, CAST(due_date AS VARCHAR) AS sort_key",
            "home_items": f"name AS title, {iso('next_due_at', 'sort_key')}",
            "contacts": f"name AS title, {iso('last_contact_at', 'sort_key')}"}
    for name, (table, where) in sections.items():
        q[name] = _with(f"SELECT {shape[table]} FROM {table} WHERE {where}")
    q["dashboard"] = _with(" UNION ALL ".join(
        f"SELECT '{name}' AS section, id, {keys[table]} FROM {table} WHERE {where}"
        for name, (table, where) in sections.items()))
    q["stale_days"] = _with(f"SELECT id, name, {_LAST_DAYS} AS days FROM contacts "
                            f"WHERE last_contact_at IS NULL OR {_LAST_DAYS} >= 14")
    q["contacts_by_name"] = _with(
        f"SELECT {_CONTACT} FROM contacts WHERE contains(lower(name), 'customer#0000001')")
    q["lookup"] = _with(f"SELECT {_TASK} FROM tasks WHERE id IN (SELECT 't'||l_orderkey FROM "
                        f"lineitem WHERE l_returnflag = 'R')")

    q["lookup_reduced"] = _with(
        f"SELECT {_TASK} FROM tasks WHERE id IN (SELECT 't'||l_orderkey FROM lineitem "
        f"WHERE l_returnflag = 'R' AND l_quantity > 45)")

    # tags
    q["tag_counts"] = _with(counts)
    q["tags_matching"] = _with(f"SELECT * FROM ({counts}) WHERE contains(tag, 'topic-1')")
    q["related_tags"] = _with(
        f"SELECT related AS tag, co_occurrence, rank FROM (SELECT *, row_number() OVER (ORDER BY "
        f"co_occurrence DESC, related) AS rank FROM ({pairs}) WHERE tag = 'topic-3') "
        f"WHERE rank <= 10")
    q["tag_pairs"] = _with(pairs)
    q["related_all"] = _with(
        f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY co_occurrence DESC, "
        f"related) AS rank FROM ({pairs})) WHERE rank <= 10")
    means = ("SELECT tag, n, CAST(unnest(range(0, dims)) AS INTEGER) AS dim, "
             "round(unnest(centroid), 6) AS mean FROM centroids")
    q["tag_centroid"] = _with(means + " WHERE tag = 'topic-3'")
    q["tag_centroids"] = _with(means)

    # statistics and review
    q["stats_by_type"] = _with("SELECT content_type, count(*) AS n FROM thoughts GROUP BY ALL")
    q["stats_total"] = _with(
        f"SELECT count(*) AS total, {iso('max(created_at)', 'most_recent')} FROM thoughts")
    q["stats_range"] = _with(
        f"SELECT count(*) AS total, {iso('min(created_at)', 'oldest')}, "
        f"{iso('max(created_at)', 'newest')} FROM thoughts")
    q["review_entries"] = _with(f"SELECT {_ITEM} {_REVIEW}")
    q["review_total"] = _with(f"SELECT count(*) AS total {_REVIEW}")
    q["review_by_type"] = _with(f"SELECT content_type, count(*) AS n {_REVIEW} GROUP BY ALL")
    q["review_top_tags"] = _with(f"""
        SELECT rank, tag, count FROM (
          SELECT tag, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, min(seen)) AS rank
          FROM (SELECT tag, row_number() OVER (ORDER BY created_at DESC, id, place) AS seen
                FROM (SELECT id, created_at, unnest(tags) AS tag,
                             generate_subscripts(tags, 1) AS place {_REVIEW}))
          GROUP BY tag) WHERE rank <= 10""")

    # notes and interactions
    whole = (f"string_agg(r.content, chr(10)||chr(10) ORDER BY r.chunk_index) AS content, p.title, "
             f"{tag_text('p.tags')}, p.content_type, {iso('p.created_at', 'created_at')}, "
             f"count(*) AS total_chunks FROM chunk_rows p JOIN chunk_rows r ")
    group = "GROUP BY p.id, p.title, p.tags, p.content_type, p.created_at"
    q["reassemble"] = _with(
        f"SELECT p.id, {whole} ON r.id = p.id OR r.parent_id = p.id "
        f"WHERE p.parent_id IS NULL {group}")
    q["thoughts_full"] = _with(
        f"SELECT p.id, {whole} ON r.id = p.id OR r.parent_id = p.id {group}")
    q["log_interactions"] = _with(
        f"SELECT id, notes, {iso('last_contact_at')}, {iso('updated_at')} FROM logged")
    q["stream_interactions"] = q["log_interactions"]
    q["parse_notes"] = _with("""
        SELECT l.id, coalesce(p.profile, '') AS profile, CAST(coalesce(h.n, 0) AS INTEGER) AS n,
               coalesce(h.interactions, '') AS interactions
        FROM logged l
        LEFT JOIN (SELECT id, string_agg(part, chr(10)||chr(10) ORDER BY place) AS profile
                   FROM note_parts WHERE NOT hit GROUP BY id) p ON p.id = l.id
        LEFT JOIN (SELECT id, count(*) AS n, string_agg(date||'|'||content, chr(10) ORDER BY seq)
                   AS interactions FROM note_hits GROUP BY id) h ON h.id = l.id""")
    q["interactions_of"] = _with(
        "SELECT id AS contact_id, CAST(seq AS INTEGER) AS place, date, content FROM note_hits")
    last = f"""SELECT contact_id, {iso('max(ts)', 'last_contact_at')}, count(*) AS interactions
        FROM interactions GROUP BY contact_id"""
    q["last_contacts"] = _with(last)
    q["stream_last_contact"] = _with(last)

    # scalar functions
    q["embed_text"] = _with(
        "SELECT id, concat_ws(chr(10), name, nullif(notes, ''), nullif(email, '')) AS text "
        "FROM contacts")
    q["normalize_tag"] = (f"SELECT p_partkey, {_norm('p_name')} AS name_tag, {_norm('p_type')} AS "
                          f"type_tag, {_norm('repeat(p_brand, 9)')} AS long_tag FROM part")
    words = ("SELECT doc_id AS k, unnest(string_split_regex(text, '{ws}')) AS raw, "
             "generate_subscripts(string_split_regex(text, '{ws}'), 1) AS place FROM documents")
    q["clean_tags"] = _fill(
        f"SELECT doc_id, coalesce(tags, '') AS tags FROM documents LEFT JOIN ({_clean(words, 20)}) "
        f"ON k = doc_id")
    q["detect_type"] = _with(r"""
        SELECT id, CASE WHEN len(list_filter(string_split(content, chr(10)||chr(10)),
                    lambda p: length(trim(p, {js})) >= 50)) >= 2
               OR len(list_filter(string_split_regex(content, '{jsws}'), lambda w: w <> '')) > 500
               THEN 'note' ELSE 'thought' END AS detected FROM thoughts""")
    short = "(epoch_us(TIMESTAMP '2024-01-12 06:30:00') - epoch_us(created_at))"
    long = "((epoch_us(TIMESTAMP '2024-06-01') - epoch_us(created_at)) // 60000000)"
    q["rel_time"] = _with(
        f"SELECT id, CASE WHEN {short} < 0 THEN 'just now' ELSE "
        f"{_ago(f'({short} // 60000000)', False)} END AS short, {_ago(long, True)} AS long "
        f"FROM thoughts")
    days = f"(due_date - {_D})"
    q["task_due_label"] = _with(f"""
        SELECT id, CASE WHEN due_date IS NULL THEN '' WHEN {days} < 0 THEN abs({days})||'d overdue'
               WHEN {days} = 0 THEN 'today' WHEN {days} = 1 THEN 'tomorrow'
               ELSE 'in '||{days}||'d' END AS label,
               coalesce(due_date < {_D} AND status = 'open', false) AS overdue FROM tasks""")
    q["home_due_label"] = _with(f"""
        SELECT id, CASE WHEN next_due_at IS NULL THEN '—'
               WHEN {_HOME_DAYS} < 0 THEN abs({_HOME_DAYS})||'d overdue'
               WHEN {_HOME_DAYS} = 0 THEN 'due today' ELSE 'due in '||{_HOME_DAYS}||'d' END AS label,
               CASE WHEN {_HOME_DAYS} < 0 THEN 'overdue' WHEN {_HOME_DAYS} <= 7 THEN 'due-soon'
               ELSE '' END AS "class" FROM home_items""")
    q["last_contact_label"] = _with(f"""
        SELECT id, {_LAST_DAYS} AS days, CASE WHEN last_contact_at IS NULL THEN 'never contacted'
               WHEN {_LAST_DAYS} = 0 THEN 'today' ELSE {_LAST_DAYS}||'d ago' END AS label
        FROM contacts""")
    q["initials"] = _with(
        "SELECT id, upper(substr(split_part(title, ' ', 1), 1, 1)||substr(split_part(title, ' ', 2),"
        " 1, 1)) AS initials FROM items")
    q["contact_details"] = _with(
        "SELECT id, concat_ws(' · ', nullif(email, ''), nullif(phone, ''), nullif(company, '')) "
        "AS details FROM contacts")

    # changes
    as_of = "'2001-07-20T00:00:00+00:00'"

    def bumped(touched, otherwise="created_at"):
        text = iso(otherwise, "updated_at").removesuffix(" AS updated_at")
        return f"CASE WHEN {touched} THEN {as_of} ELSE {text} END AS updated_at"

    state = f"SELECT {_STATE}, {bumped('touched')} FROM updated"
    q["update_tasks"] = _with(state)
    q["latest_rows"] = _with(state)
    q["merge_task_changes"] = _with(state)
    q["updated_tasks"] = _with(state + " WHERE touched")
    q["needs_reembed"] = _with(
        "SELECT id, concat_ws(chr(10), nullif(title, ''), nullif(notes, '')) AS text FROM updated "
        "WHERE text_given")
    q["update_contacts"] = _with(f"""
        SELECT id, name, coalesce(n.phone, c.phone) AS phone, coalesce(n.company, c.company) AS
               company, {bumped('n.phone IS NOT NULL OR n.company IS NOT NULL')}
        FROM contacts c LEFT JOIN (
          SELECT 'c'||o_custkey AS id,
                 arg_max('phone-'||o_orderkey, o_orderkey) FILTER (o_orderstatus = 'P') AS phone,
                 arg_max(o_orderpriority, o_orderkey) FILTER (o_orderstatus = 'F') AS company
          FROM orders GROUP BY o_custkey) n USING (id)""")
    version = "({shipped} * 100000000 + l_orderkey) * 100000 + l_suppkey * 10 + l_linenumber"
    q["update_home"] = _with(f"""
        SELECT id, name, coalesce(n.notes, h.notes) AS notes,
               coalesce(n.interval_days, h.interval_days) AS interval_days,
               {bumped('n.notes IS NOT NULL OR n.interval_days IS NOT NULL')}
        FROM home_items h LEFT JOIN (
          SELECT 'h'||l_partkey AS id,
                 arg_max(l_linenumber, {version}) FILTER (l_returnflag = 'R') AS interval_days,
                 arg_max('order '||l_orderkey, {version}) FILTER (l_linestatus = 'O') AS notes
          FROM lineitem GROUP BY l_partkey) n USING (id)""")
    q["update_thoughts"] = _with(f"""
        SELECT id, CASE WHEN toxic = 1 THEN '[removed]' ELSE content END AS content,
               CASE WHEN quality = 1 THEN 'Good '||doc_id ELSE title END AS title,
               array_to_string(CASE WHEN toxic = 1 THEN ['flagged'] ELSE tags END, '|') AS tags,
               CASE WHEN toxic = 1 OR quality = 1 THEN '2024-01-12T00:00:00+00:00' ELSE
               {iso('created_at', 'x').removesuffix(' AS x')} END AS updated_at,
               CASE WHEN toxic = 1 THEN 1.0 ELSE round(list_max(CAST(embedding AS DOUBLE[])), 6) END
               AS top_weight
        FROM thoughts LEFT JOIN labels ON id = 'd'||doc_id""")
    q["delete_tasks"] = _with("SELECT id, title, status FROM tasks WHERE id NOT IN "
                              "(SELECT 't'||l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
    gone = "SELECT id FROM chunk_rows WHERE parent_id IS NULL AND length(content) > 150"
    q["delete_thoughts"] = _with(
        f"SELECT id, parent_id, chunk_index FROM chunk_rows WHERE id NOT IN ({gone}) "
        f"AND (parent_id IS NULL OR parent_id NOT IN ({gone}))")
    q["delete_tasks_reduced"] = q["delete_tasks"]
    q["delete_thoughts_reduced"] = q["delete_thoughts"]
    q["complete_tasks"] = _with(f"""
        SELECT id, title, notes, CASE WHEN hit THEN 'done' ELSE status END AS status, priority,
               CAST(due_date AS VARCHAR) AS due_date, category, {tag_text()}, {bumped('hit')}
        FROM (SELECT *, id IN (SELECT id FROM completions) AS hit FROM tasks)
        UNION ALL SELECT {_STATE}, {as_of} FROM spawned""")
    q["next_tasks"] = _with(
        f"SELECT {_TASK.replace(iso('created_at'), as_of + ' AS created_at')} FROM spawned")
    q["complete_home"] = _with(f"""
        SELECT {_HOME} FROM (
          SELECT id, name, notes, interval_days, tags, created_at,
                 coalesce(ts, last_done_at) AS last_done_at,
                 CASE WHEN ts IS NOT NULL AND interval_days IS NOT NULL
                      THEN ts + to_days(interval_days) ELSE next_due_at END AS next_due_at
          FROM home_items LEFT JOIN (
            SELECT 'h'||l_partkey AS id, max(l_shipdate + to_days(l_linenumber)) AS ts
            FROM lineitem GROUP BY l_partkey) USING (id))""")

    # vector search
    hit = f"rank, id, title, content_type, {tag_text()}, round(similarity, 6) AS similarity"
    q["cosine"] = _with(
        "SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 6) AS "
        "similarity FROM embeddings, query_vectors WHERE query_id = 0")
    q["search"] = _with(_nearest("items", 0, hit, 10))
    q["search_tasks"] = _with(_nearest("items", 0, hit, 10, "content_type = 'task'"))
    q["search_thoughts"] = _with(
        _nearest("thoughts", 0, "rank, id, source, round(similarity, 6) AS similarity", 10))
    q["search_pct"] = _with(_nearest(
        "items", 1, "rank, id, CAST(floor(similarity * 100 + 0.5) AS BIGINT) AS pct", 20))
    scored = "list_cosine_similarity(CAST(embedding AS DOUBLE[]), centroid) AS similarity"
    q["suggested"] = _with(
        f"SELECT {hit} FROM (SELECT *, row_number() OVER (ORDER BY similarity DESC, id) AS rank FROM "
        f"(SELECT i.*, {scored} FROM items i, centroids c WHERE c.tag = 'topic-3' AND embedding IS "
        f"NOT NULL AND NOT list_contains(tags, 'topic-3'))) WHERE rank <= 8")
    q["tag_page"] = (
        f"SELECT 'items' AS section, id AS key, CAST(NULL AS INTEGER) AS rank, CAST(NULL AS DOUBLE) AS "
        f"value FROM ({_with(by_tag)}) UNION ALL SELECT 'related', tag, rank, CAST(co_occurrence AS "
        f"DOUBLE) FROM ({q['related_tags']}) UNION ALL SELECT 'suggested', id, rank, similarity "
        f"FROM ({q['suggested']})")
    q["search_batch"] = _with(
        "SELECT CAST(query_id AS VARCHAR) AS query_id, rank, id, round(similarity, 6) AS similarity "
        "FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS "
        "rank FROM (SELECT query_id, id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) AS "
        "similarity FROM items, query_vectors WHERE embedding IS NOT NULL)) WHERE rank <= 10")
    q["search_pruned"] = q["search_batch"]
    q["search_batch_items"] = _with(
        f"SELECT CAST(query_id AS VARCHAR) AS query_id, rank, id, content, title, content_type, "
        f"{tag_text()}, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM (SELECT i.*, query_id, "
        f"list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) AS similarity FROM items i, "
        f"query_vectors WHERE embedding IS NOT NULL AND content_type = 'contact')) WHERE rank <= 5")
    q["suggest_all"] = _with(
        f"SELECT tag, rank, id, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY tag ORDER BY similarity DESC, id) AS rank FROM (SELECT c.tag, i.id, {scored} "
        f"FROM items i, centroids c WHERE embedding IS NOT NULL AND NOT list_contains(tags, c.tag)))"
        f" WHERE rank <= 8")

    def weights(texts):
        """The largest weight of each text's hash embedding."""
        return (
            "SELECT id, round(CAST(CAST(max(n) / sqrt(sum(n * n)) AS FLOAT) AS DOUBLE), 6) AS w FROM "
            "(SELECT id, CAST('0x'||substr(md5(word), 1, 8) AS BIGINT) % 64 AS bucket, "
            "CAST(count(*) AS DOUBLE) AS n FROM (SELECT id, unnest(string_split_regex(lower(text), "
            f"'{{ws}}')) AS word FROM ({texts})) WHERE word <> '' GROUP BY ALL) GROUP BY id")

    def reembedded(table, texts):
        return _with(
            f"SELECT t.id, coalesce(x.w, round(list_max(CAST(embedding AS DOUBLE[])), 6)) AS top_weight "
            f"FROM {table} t LEFT JOIN ({weights(texts)}) x ON x.id = t.id")

    joined = "concat_ws(chr(10), nullif({}, ''), nullif({}, '')) AS text"
    q["reembed_tasks"] = reembedded(
        "tasks", f"SELECT id, {joined.format('title', 'notes')} FROM updated WHERE text_given")
    q["reembed_contacts"] = reembedded("contacts", f"""
        SELECT id, {joined.format('name', 'n.notes')} FROM contacts c JOIN (
          SELECT 'c'||o_custkey AS id,
                 arg_max('order '||o_orderkey, o_orderkey) FILTER (o_orderstatus = 'F') AS notes
          FROM orders GROUP BY o_custkey) n USING (id) WHERE n.notes IS NOT NULL""")
    q["reembed_home"] = reembedded("home_items", f"""
        SELECT id, {joined.format('name', 'n.notes')} FROM home_items h JOIN (
          SELECT 'h'||l_partkey AS id,
                 arg_max('order '||l_orderkey, {version}) FILTER (l_linestatus = 'O') AS notes
          FROM lineitem GROUP BY l_partkey) n USING (id) WHERE n.notes IS NOT NULL""")
    q["reembed_interactions"] = reembedded("contacts", f"""
        SELECT l.id, {joined.format('c.name', 'l.notes')} FROM logged l JOIN contacts c USING (id)
        WHERE l.id IN (SELECT contact_id FROM interactions)""")
    q["search_approx"] = _with(f"""
        WITH planes AS (
          SELECT p, list(CASE WHEN substr(md5(p||':'||d), 1, 1) < '8' THEN 1.0::DOUBLE ELSE -1.0 END
                         ORDER BY d) AS v
          FROM (SELECT unnest(range(0, {BITS})) AS p), (SELECT unnest(range(1, 65)) AS d) GROUP BY p),
        item_bits AS (
          SELECT id, CAST(string_agg(CASE WHEN list_inner_product(CAST(embedding AS DOUBLE[]), v) >= 0
                                     THEN '1' ELSE '0' END, '' ORDER BY p) AS BIT) AS bits
          FROM items, planes WHERE embedding IS NOT NULL GROUP BY id),
        query_bits AS (
          SELECT query_id, CAST(string_agg(CASE WHEN list_inner_product(q, v) >= 0
                                           THEN '1' ELSE '0' END, '' ORDER BY p) AS BIT) AS bits
          FROM query_vectors, planes GROUP BY query_id),
        probed AS (SELECT query_id, id FROM query_bits a JOIN item_bits b
                   ON bit_count(xor(a.bits, b.bits)) <= {differing()})
        SELECT CAST(query_id AS VARCHAR) AS query_id, rank, id, round(similarity, 6) AS similarity
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank
              FROM (SELECT query_id, id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) AS
                           similarity
                    FROM probed JOIN query_vectors USING (query_id) JOIN items USING (id)))
        WHERE rank <= 10""")
    # vectors of full width: words counted in 384 buckets, sums over shared buckets
    def buckets(texts, key):
        return (
            f"SELECT {key}, bucket, CAST(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS FLOAT) "
            f"AS DOUBLE) AS w FROM (SELECT {key}, CAST('0x'||substr(md5(word), 1, 8) AS BIGINT) % 384 "
            f"AS bucket, CAST(count(*) AS DOUBLE) AS n FROM (SELECT {key}, unnest(string_split_regex("
            f"lower(text), '{{ws}}')) AS word FROM ({texts})) WHERE word <> '' GROUP BY ALL)")

    texts = ("SELECT id, content AS text FROM thoughts " + "".join(
        f"UNION ALL SELECT id, {joined.format(name, 'notes')} FROM {table} "
        for table, name in (("tasks", "title"), ("contacts", "name"), ("home_items", "name"))))
    wide = {
        "wide": buckets(texts, "id"),
        "wide_norm": "SELECT id, sqrt(sum(w * w)) AS length FROM wide GROUP BY id",
        "asked": buckets("SELECT item_id, text FROM benchmark", "item_id"),
        "asked_norm": "SELECT item_id, sqrt(sum(w * w)) AS length FROM asked GROUP BY item_id",
        "wide_pairs": """
            SELECT item_id AS query_id, id, coalesce(dot, 0) / (n.length * m.length) AS similarity
            FROM wide_norm n CROSS JOIN asked_norm m LEFT JOIN (
              SELECT a.item_id, w.id, sum(a.w * w.w) AS dot FROM asked a JOIN wide w USING (bucket)
              GROUP BY ALL) USING (item_id, id)""",
        "means": """
            SELECT tag, bucket, sum(w) / any_value(n) AS w
            FROM (SELECT DISTINCT id, tag FROM item_tags)
            JOIN (SELECT tag, count(DISTINCT id) AS n FROM item_tags JOIN wide_norm USING (id)
                  GROUP BY tag) USING (tag) JOIN wide USING (id) GROUP BY tag, bucket""",
        "mean_norm": "SELECT tag, sqrt(sum(w * w)) AS length FROM means GROUP BY tag",
    }
    by_rank = ("SELECT *, row_number() OVER ({over}ORDER BY round(similarity, 12) DESC, id) AS rank "
               "FROM ({rows})")
    found = by_rank.format(over="", rows="SELECT i.*, similarity FROM wide_pairs JOIN items i USING "
                                         "(id) WHERE query_id = 0")
    q["search_wide"] = _with(f"SELECT {hit} FROM ({found}) WHERE rank <= 10", **wide)
    found = by_rank.format(over="PARTITION BY query_id ", rows="SELECT * FROM wide_pairs")
    q["search_batch_wide"] = _with(
        f"SELECT CAST(query_id AS VARCHAR) AS query_id, rank, id, round(similarity, 6) AS similarity "
        f"FROM ({found}) WHERE rank <= 5", **wide)
    found = by_rank.format(over="PARTITION BY tag ", rows="""
        SELECT m.tag, n.id, coalesce(dot, 0) / (n.length * m.length) AS similarity
        FROM wide_norm n CROSS JOIN mean_norm m LEFT JOIN (
          SELECT c.tag, w.id, sum(c.w * w.w) AS dot FROM means c JOIN wide w USING (bucket)
          GROUP BY ALL) d ON d.tag = m.tag AND d.id = n.id
        WHERE NOT EXISTS (SELECT 1 FROM item_tags t WHERE t.id = n.id AND t.tag = m.tag)""")
    q["suggest_wide"] = _with(
        f"SELECT tag, rank, id, round(similarity, 6) AS similarity FROM ({found}) WHERE rank <= 3",
        **wide)
    q["stream_rejected"] = (
        f"SELECT entry_id, reasons FROM ({q['validate_entries']}) WHERE reasons <> ''")
    q["stream_contacts"] = _with(f"""
        SELECT id, name, {iso('greatest(last_contact_at, last)', 'last_contact_at')},
               {iso('greatest(created_at, last)', 'updated_at')}
        FROM contacts LEFT JOIN (SELECT contact_id, max(ts) AS last FROM interactions
                                 GROUP BY contact_id) ON contact_id = id""")

    # activity windows
    heads = ("(SELECT created_at, content_type, tags FROM thoughts UNION ALL SELECT created_at, "
             "content_type, tags FROM chunk_rows WHERE parent_id IS NULL)")
    q["activity_daily"] = _with(_activity(1, 1, "").replace("FROM thoughts", f"FROM {heads}"))
    q["stream_activity_all"] = _with(_activity(1, 7, "").replace("FROM thoughts", f"FROM {heads}"))
    q["stream_activity"] = _with(_activity(
        1, 7, "WHERE w + INTERVAL 7 DAY <= (SELECT max(created_at) FROM thoughts) - INTERVAL 1 DAY"))
    for name, sql in q.items():
        for column in _INTEGERS.get(name, ()):
            sql = f"SELECT * REPLACE (CAST({column} AS INTEGER) AS {column}) FROM ({sql})"
        q[name] = sql
    return q


ORACLE = _build()
