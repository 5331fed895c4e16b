"""DuckDB SQL that computes what the queries of the same name compute."""

from __future__ import annotations

from kinshelf.config import Settings
from kinshelf.functions.fixed_values import NAMING_IGNORE, STOP_WORDS


def _quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


IGNORE, STOP = _quoted(NAMING_IGNORE), _quoted(STOP_WORDS)

FILES = """files AS (
    SELECT doc_id, source || '/' || doc_id || '.txt' AS file_path, doc_id || '.txt' AS filename,
           strlen(text)::BIGINT AS file_size,
           TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS modification_date,
           source, lang, text
    FROM documents)"""

CATALOG = FILES + """,
catalog AS (
    SELECT f.*, 'text' AS file_type, sha256(f.text) AS checksum, l.quality, l.toxic,
           'q' || l.quality AS cluster_id, coalesce(l.quality * 0.5, 0.0)::DOUBLE AS confidence_score,
           'q' || l.quality AS proposed_cluster_id
    FROM files f LEFT JOIN labels l USING (doc_id)),
labelled AS (SELECT f.*, l.quality, l.toxic FROM files f JOIN labels l USING (doc_id))"""

OPERATIONS = """operations AS (
    SELECT event_id::VARCHAR AS operation_id, ts AS timestamp,
           CASE event_type WHEN 'signup' THEN 'create_folder' WHEN 'error' THEN 'delete_folder'
                ELSE 'move' END AS operation_type,
           CASE WHEN event_type <> 'signup' THEN 'user' || user_id || '/' || event_id || '.txt' END
               AS source_path,
           CASE WHEN event_type <> 'error'
                THEN 'folder' || (user_id % 10) || '/' || event_id || '.txt' END AS destination_path,
           value > 5 AS success, user_id, value
    FROM events)"""


def _change_path(offset: int) -> str:
    n = f"(floor(abs(value) * 100)::BIGINT + {offset})"
    return (
        f"['notes', '.git', 'build', 'a/b', 'c/.x'][({n} % 5) + 1] || '/' || ({n} % 400) || '.' || "
        f"['txt', 'md', 'png', 'PDF', 'log', 'jpg', 'rst'][({n} % 7) + 1]"
    )


CHANGES = f"""changes AS (
    SELECT ts, event_id, user_id,
           CASE event_type WHEN 'signup' THEN 'created' WHEN 'purchase' THEN 'moved'
                WHEN 'error' THEN 'deleted' ELSE 'modified' END AS kind,
           {_change_path(0)} AS path,
           CASE WHEN event_type = 'purchase' THEN {_change_path(3)} END AS dest_path
    FROM events)"""


def _supported(path: str) -> str:
    return f"regexp_matches(lower({path}), '[^/]\\.(txt|md|rst|log|pdf)$')"


def _excluded(path: str) -> str:
    return (
        f"regexp_matches('/' || {path} || '/', '/\\.|/(kinshelf\\.egg-info|__pycache__|"
        f"node_modules|venv|env|dist|build)/')"
    )


NORMALIZED = f"""normalized AS (
    SELECT ts, event_id, user_id, 'deleted' AS action, path FROM changes
    WHERE kind IN ('deleted', 'moved') AND NOT {_excluded('path')}
    UNION ALL
    SELECT ts, event_id, user_id, 'changed', dest_path FROM changes
    WHERE kind = 'moved' AND {_supported('dest_path')} AND NOT {_excluded('path')}
    UNION ALL
    SELECT ts, event_id, user_id, 'changed', path FROM changes
    WHERE kind IN ('created', 'modified') AND {_supported('path')} AND NOT {_excluded('path')})"""

PATHS = """paths AS (
    SELECT page_id, url,
           ['', '.git/', 'build/', 'src/', 'x/.hidden/', 'env/', 'envy/'][(page_id % 7) + 1]
           || regexp_extract(url, '^https?://([^?#]*[^/?#])', 1)
           || ['.TXT', '.md', '', '.pdf', '.html', '.log'][(page_id % 6) + 1] AS path
    FROM pages)"""

TOKENS = f"""tokens AS (
    SELECT doc_id, lang, source,
           [w FOR w IN regexp_extract_all(lower(text), '[a-z]{{3,}}') IF w NOT IN ({IGNORE})] AS words
    FROM documents)"""

# Words without stop words, then pairs of neighbours.
TERMS = TOKENS + f""",
kept AS (SELECT doc_id, lang, source, [w FOR w IN words IF w NOT IN ({STOP})] AS words FROM tokens),
terms AS (
    SELECT doc_id, lang, source, list_concat(words,
        [words[i] || ' ' || words[i + 1] FOR i IN range(1, len(words))]) AS terms
    FROM kept)"""

BAGS = TOKENS + """,
bags AS (
    SELECT doc_id, CASE WHEN len(words) = 0 THEN 'doc ' || doc_id
                   ELSE array_to_string(list_sort(words), ' ') END AS bag
    FROM tokens),
copies AS (
    SELECT doc_id, min(doc_id) OVER (PARTITION BY bag) AS rep,
           count(*) OVER (PARTITION BY bag) AS n
    FROM bags)"""

VECTORS = """
tf AS (SELECT doc_id, term, count(*) AS tf
       FROM (SELECT doc_id, unnest(words) AS term FROM tokens) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
weights AS (
    SELECT doc_id, term,
           (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w
    FROM tf JOIN df USING (term)),
vectors AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM weights)"""

REP_PAIRS = BAGS + "," + VECTORS + """,
reps AS (SELECT v.* FROM vectors v JOIN copies c ON c.doc_id = v.doc_id AND c.rep = c.doc_id),
pairs AS (
    SELECT a.doc_id AS src, b.doc_id AS dst, sum(a.w * b.w) AS sim
    FROM reps a JOIN reps b ON a.term = b.term AND a.doc_id < b.doc_id
    GROUP BY ALL HAVING sum(a.w * b.w) >= 0.55)"""

DENSE = """vec AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS v, label FROM embeddings),
dense_pairs AS (
    SELECT a.doc_id AS src, b.doc_id AS dst, list_cosine_similarity(a.v, b.v) AS sim
    FROM vec a JOIN vec b ON a.doc_id < b.doc_id
    WHERE list_cosine_similarity(a.v, b.v) >= 0.25)"""


def _components(edges: str, name: str) -> str:
    """Every node of ``edges(src, dst)`` with the smallest node it reaches."""
    return f"""{name}_both AS (
    SELECT src AS a, dst AS b FROM {edges} UNION SELECT dst, src FROM {edges}),
{name}_reach(doc_id, other) AS (
    SELECT a, a FROM {name}_both
    UNION
    SELECT r.doc_id, e.b FROM {name}_reach r JOIN {name}_both e ON e.a = r.other),
{name} AS (SELECT doc_id, min(other) AS grp FROM {name}_reach GROUP BY doc_id)"""


DENSE_GROUPS = DENSE + """,
close_pairs AS (SELECT * FROM dense_pairs WHERE sim >= 0.35),
""" + _components("close_pairs", "comp") + """,
dense_grouped AS (SELECT v.doc_id, v.v, c.grp FROM vec v LEFT JOIN comp c USING (doc_id))"""

FAMILY_WEIGHTS = TERMS + """,
counts AS (SELECT lang AS family, source AS grp, term, count(*) AS tf
           FROM (SELECT lang, source, unnest(terms) AS term FROM terms) GROUP BY ALL),
families AS (SELECT lang AS family, count(DISTINCT source) AS n FROM documents GROUP BY lang),
spread AS (
    SELECT family, term, count(*) AS df, sum(tf) AS total, any_value(n) AS n
    FROM counts JOIN families USING (family) GROUP BY family, term
    HAVING count(*) <= 0.7 * any_value(n)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY total DESC, term) AS r FROM spread),
raw AS (
    SELECT family, grp, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w
    FROM counts JOIN ranked USING (family, term)),
group_weights AS (
    SELECT family, grp, term, w / sqrt(sum(w * w) OVER (PARTITION BY family, grp)) AS w FROM raw)"""

BOOSTED = FAMILY_WEIGHTS + """,
docs AS (SELECT lang AS family, source AS grp, array_to_string(words, ' ') AS doc FROM tokens),
shares AS (
    SELECT family, grp, term, any_value(w) AS w, count(*) AS size,
           count(*) FILTER (contains(doc, term)) / count(*) AS share
    FROM group_weights JOIN docs USING (family, grp) GROUP BY family, grp, term),
boosted AS (
    SELECT family, grp, term,
           CASE WHEN size = 1 THEN w ELSE w * (0.4 + 0.6 * share)
                * CASE WHEN contains(term, ' ') THEN 1.3 ELSE 1 END END AS score
    FROM shares)"""

# Compared terms only, as many as the query names.
BOOSTED_FREQUENT = BOOSTED.replace(
    "JOIN ranked USING (family, term))", "JOIN ranked USING (family, term) WHERE r <= 40 * n)"
)

ASSIGNED = FILES + """,
assigned AS (
    SELECT doc_id, 'A/q' || quality || '/' || source AS folder
    FROM files JOIN labels USING (doc_id)),
denials AS (
    SELECT doc_id, trim(CASE doc_id % 4 WHEN 0 THEN '/A/q1/'
        WHEN 1 THEN 'A/q0/' || source || '/deep' WHEN 2 THEN 'A/q'
        ELSE 'A/q1/' || source END, '/') AS d
    FROM files),
approved AS (
    SELECT a.* FROM assigned a LEFT JOIN denials n USING (doc_id)
    WHERE n.d IS NULL OR NOT (n.d = folder OR starts_with(folder, n.d || '/')
                              OR starts_with(n.d, folder || '/')))"""

TWINS = """twins AS (
    SELECT side || '/' || item_id || '.txt' AS file_path
    FROM benchmark, (VALUES ('left'), ('right')) s(side))"""

KEYWORDS = TERMS + """,
members AS (
    SELECT source AS cluster_id, doc_id FROM documents
    UNION ALL SELECT 'd' || doc_id, doc_id FROM labels),
sizes AS (SELECT cluster_id, count(*) AS size FROM members GROUP BY cluster_id),
alone AS (
    SELECT cluster_id, words[i] AS term, i
    FROM (SELECT cluster_id, words, unnest(range(1, len(words) + 1)) AS i
          FROM members JOIN sizes USING (cluster_id) JOIN tokens USING (doc_id) WHERE size = 1)),
alone_ranked AS (
    SELECT cluster_id, term, row_number() OVER (
        PARTITION BY cluster_id ORDER BY count(*) DESC, min(i)) AS r
    FROM alone GROUP BY cluster_id, term),
doc_tf AS (
    SELECT cluster_id, doc_id, any_value(size) AS size, term, count(*) AS tf
    FROM (SELECT cluster_id, doc_id, size, unnest(terms) AS term
          FROM members JOIN sizes USING (cluster_id) JOIN terms USING (doc_id) WHERE size > 1)
    GROUP BY cluster_id, doc_id, term),
totals AS (
    SELECT cluster_id, term, ln((1 + any_value(size)) / (1 + count(*))) + 1 AS idf,
           row_number() OVER (PARTITION BY cluster_id ORDER BY sum(tf) DESC, term) AS r
    FROM doc_tf GROUP BY cluster_id, term),
weighed AS (
    SELECT cluster_id, doc_id, term, (1 + ln(tf)) * idf AS w
    FROM doc_tf JOIN totals USING (cluster_id, term)),
normed AS (
    SELECT cluster_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY cluster_id, doc_id)) AS w
    FROM weighed),
scored AS (
    SELECT cluster_id, term, sum(w) AS w,
           split_part(term, ' ', 1) IS DISTINCT FROM split_part(term, ' ', 2) AS usable
    FROM normed GROUP BY cluster_id, term),
usable AS (
    SELECT *, round(w * CASE WHEN usable AND contains(term, ' ') THEN 1.4 ELSE 1 END, 12) AS score
    FROM (SELECT *, bool_or(usable) OVER (PARTITION BY cluster_id) AS any_usable FROM scored)
    WHERE usable OR NOT any_usable),
shared_ranked AS (
    SELECT cluster_id, term,
           row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, term DESC) AS r
    FROM usable)"""

def _recursion(settings: Settings) -> str:
    """The documents' last groups, level by level, from ``vectors(doc_id, v)`` and ``sims(src, dst, sim)``."""
    parts = ["act0 AS (SELECT 'root' AS parent, doc_id FROM vectors)"]
    ended = []
    for d in range(settings.max_depth + 1):
        parts.append(f"""
        close{d} AS (
            SELECT src, dst FROM sims JOIN act{d} a ON a.doc_id = src JOIN act{d} b ON b.doc_id = dst
            WHERE a.parent = b.parent AND sim >= {settings.threshold_at(d)!r}),
        {_components(f"close{d}", f"comp{d}")},
        joined{d} AS (SELECT parent, doc_id, grp FROM act{d} LEFT JOIN comp{d} USING (doc_id)),
        sums{d} AS (
            SELECT parent, grp, i, avg(v[i]) AS m
            FROM (SELECT parent, grp, v, unnest(range(1, len(v) + 1)) AS i
                  FROM joined{d} JOIN vectors USING (doc_id) WHERE grp IS NOT NULL)
            GROUP BY parent, grp, i),
        means{d} AS (SELECT parent, grp, list(m ORDER BY i) AS m FROM sums{d} GROUP BY parent, grp),
        near{d} AS (
            SELECT j.parent, j.doc_id, m.grp, list_cosine_similarity(v, m.m) AS sim
            FROM joined{d} j JOIN vectors USING (doc_id) JOIN means{d} m ON m.parent = j.parent
            WHERE j.grp IS NULL
            QUALIFY row_number() OVER (PARTITION BY j.parent, j.doc_id ORDER BY sim DESC, m.grp) = 1),
        placed{d} AS (
            SELECT j.parent, j.doc_id, coalesce(j.grp, n.grp) AS grp FROM joined{d} j
            LEFT JOIN near{d} n ON n.parent = j.parent AND n.doc_id = j.doc_id
                 AND n.sim >= {settings.absorb_threshold_at(d)!r}),
        loose{d} AS (
            SELECT src, dst FROM sims JOIN placed{d} a ON a.doc_id = src JOIN placed{d} b ON b.doc_id = dst
            WHERE a.grp IS NULL AND b.grp IS NULL AND a.parent = b.parent
                  AND sim >= {settings.loose_threshold_at(d)!r}),
        {_components(f"loose{d}", f"left{d}")},
        step{d} AS (
            SELECT p.parent, p.doc_id, coalesce(p.grp, l.grp, p.doc_id) AS grp
            FROM placed{d} p LEFT JOIN left{d} l ON l.doc_id = p.doc_id AND p.grp IS NULL),
        judged{d} AS (
            SELECT s.*, groups > 1 AS split,
                   groups > 1 AND {d} < {settings.max_depth} AND size >= {settings.min_cluster_size_for_split} AS again
            FROM step{d} s
            JOIN (SELECT parent, grp, count(*) AS size FROM step{d} GROUP BY parent, grp) USING (parent, grp)
            JOIN (SELECT parent, count(DISTINCT grp) AS groups FROM step{d} GROUP BY parent) USING (parent)),
        act{d + 1} AS (SELECT grp::VARCHAR AS parent, doc_id FROM judged{d} WHERE again)""")
        ended.append(f"""SELECT doc_id, ({d} + split::INTEGER)::BIGINT AS level,
            CASE WHEN split THEN grp::VARCHAR ELSE parent END AS parent FROM judged{d} WHERE NOT again""")
    return ", ".join(parts) + " " + " UNION ALL ".join(ended)


ORACLES: dict[str, str] = {
    "recursive_clusters": f"""WITH RECURSIVE vectors AS (
            SELECT vec_id AS doc_id, embedding::DOUBLE[] AS v FROM embeddings),
        sims AS MATERIALIZED (
            SELECT * FROM (SELECT a.doc_id AS src, b.doc_id AS dst, list_cosine_similarity(a.v, b.v) AS sim
                           FROM vectors a JOIN vectors b ON a.doc_id < b.doc_id) WHERE sim > 0.3),
        {_recursion(Settings(similarity_threshold=0.35))}""",
    "scan_files": f"""WITH {FILES}, placed AS (
            SELECT *, CASE WHEN doc_id % 9 = 0 THEN '_' WHEN doc_id % 11 = 0 THEN '.hidden/' ELSE '' END
                   || lang || '/' || filename AS place FROM files)
        SELECT place AS file_path, filename, file_size, 'text' AS file_type, sha256(text) AS checksum
        FROM placed WHERE NOT starts_with(place, '.')""",
    "scan_changes": f"""WITH {CATALOG}, seen AS (
            SELECT CASE WHEN quality = 0 THEN 'new/' || file_path ELSE file_path END AS file_path,
                   file_size + toxic AS size,
                   modification_date + to_seconds(CASE WHEN lang = 'fr' THEN 1 ELSE 0 END) AS time
            FROM labelled WHERE lang <> 'de')
        SELECT coalesce(f.file_path, s.file_path) AS file_path,
               CASE WHEN f.file_path IS NULL THEN 'new' WHEN s.file_path IS NULL THEN 'removed' ELSE 'edited' END AS status
        FROM files f FULL JOIN seen s ON f.file_path = s.file_path
        WHERE f.file_path IS NULL OR s.file_path IS NULL OR f.file_size <> s.size OR f.modification_date <> s.time""",
    "unicode_tokens": f"""WITH tokens AS (
            SELECT doc_id, [w FOR w IN regexp_extract_all(lower(text),
                '[\\p{{Han}}々]{{2,}}|\\p{{Hiragana}}{{2,}}|[\\p{{Katakana}}ー]{{2,}}|[\\p{{L}}\\p{{M}}]{{3,}}')
                IF w NOT IN ({IGNORE})] AS words
            FROM documents)
        SELECT doc_id, len(words) AS n, sha256(array_to_string(words, ' ')) AS digest FROM tokens""",
    "keyword_labels": f"""WITH {KEYWORDS}, lists AS (
            SELECT cluster_id, list(term ORDER BY r) AS terms
            FROM (SELECT * FROM alone_ranked UNION ALL SELECT * FROM shared_ranked)
            WHERE r <= 5 GROUP BY cluster_id),
        titled AS (
            SELECT cluster_id, [[array_to_string([upper(w[1]) || w[2:] FOR w IN string_split(term, ' ')], '_')]
                                FOR term IN terms] AS words FROM lists),
        merged AS (
            SELECT cluster_id, list_reduce(words, lambda kept, x: CASE
                WHEN len([e FOR e IN kept IF contains(lower(e), lower(x[1]))]) > 0 THEN kept
                WHEN len([e FOR e IN kept IF contains(lower(x[1]), lower(e))]) > 0
                THEN [CASE WHEN e = [f FOR f IN kept IF contains(lower(x[1]), lower(f))][1] THEN x[1] ELSE e END
                      FOR e IN kept]
                ELSE list_concat(kept, x) END, []::VARCHAR[]) AS words FROM titled),
        once AS (
            SELECT cluster_id, list_reduce([[w] FOR w IN words], lambda kept, x: CASE
                WHEN list_contains([lower(e) FOR e IN kept], lower(x[1])) THEN kept
                ELSE list_concat(kept, x) END, []::VARCHAR[]) AS words FROM merged)
        SELECT cluster_id, CASE
            WHEN len(words) > 1 AND len(string_split(words[1], '_')) + len(string_split(words[2], '_')) <= 2
            THEN words[1] || '_' || words[2] ELSE words[1] END AS label
        FROM once""",
    "components_after_changes": """WITH RECURSIVE now AS (
            SELECT vec_id AS doc_id, embedding::DOUBLE[] AS v FROM embeddings WHERE label NOT IN (0, 1)
            UNION ALL SELECT vec_id, list_reverse(embedding)::DOUBLE[] FROM embeddings WHERE label = 1
            UNION ALL SELECT vec_id + 1000000, list_concat([-x FOR x IN embedding[:8]], embedding[9:])::DOUBLE[]
            FROM embeddings WHERE label = 2),
        pairs AS (
            SELECT a.doc_id AS src, b.doc_id AS dst, list_cosine_similarity(a.v, b.v) AS sim
            FROM now a JOIN now b ON a.doc_id < b.doc_id),
        edges AS (
            SELECT level, src, dst FROM pairs JOIN (VALUES (0, 0.35), (1, 0.45), (2, 0.55)) l(level, t) ON sim >= t),
        both_ways AS (SELECT * FROM edges UNION ALL SELECT level, dst, src FROM edges),
        reach AS (
            SELECT DISTINCT level, src AS doc_id, src AS other FROM both_ways
            UNION SELECT r.level, r.doc_id, e.dst FROM reach r JOIN both_ways e
                  ON e.level = r.level AND e.src = r.other)
        SELECT level::BIGINT AS level, doc_id, min(other) AS component FROM reach GROUP BY level, doc_id""",
    "fingerprint": "SELECT doc_id, sha256(text) AS checksum FROM documents",
    "describe_documents": f"""WITH {FILES}
        SELECT file_path, filename, file_size, modification_date, 'text' AS file_type,
               sha256(text) AS checksum
        FROM files""",
    "catalog_lookup": f"""WITH {CATALOG}
        SELECT file_path, filename, checksum, cluster_id, confidence_score
        FROM catalog WHERE file_path = 'src7/7.txt'""",
    "schema_evolution": f"""WITH {FILES}
        SELECT file_path, file_size, NULL::VARCHAR AS cluster_id, NULL::DOUBLE AS confidence_score,
               NULL::VARCHAR AS denied_folder_path FROM files""",
    "operation_log": f"""WITH {OPERATIONS}
        SELECT operation_type, success, count(*) AS n, count(source_path) AS sources,
               0::BIGINT AS checksums, max(timestamp) AS latest
        FROM operations GROUP BY operation_type, success""",
    "organized_sink": f"""WITH {FILES}
        SELECT CASE WHEN toxic = 0 THEN 'q' || quality || '/' || source ELSE '.' END AS folder,
               count(*) AS files, sum(length(text))::BIGINT AS chars
        FROM files LEFT JOIN labels USING (doc_id) GROUP BY 1""",
    "upsert_files": f"""WITH {CATALOG}
        SELECT file_path, filename, checksum, cluster_id FROM catalog WHERE quality IS NULL
        UNION ALL SELECT file_path, filename, sha256(text || '2'), NULL FROM labelled
        UNION ALL SELECT 'bench/' || item_id || '.txt', item_id || '.txt', sha256(text), NULL
        FROM benchmark""",
    "delete_files": f"""WITH {CATALOG}
        SELECT file_path, checksum FROM catalog WHERE coalesce(toxic, 0) <> 1""",
    "assign_cluster": f"""WITH {CATALOG}
        SELECT file_path, filename,
               CASE WHEN quality IS NULL THEN cluster_id WHEN doc_id % 2 = 0 THEN 'z'
                    WHEN toxic = 0 THEN 't' || quality END AS cluster_id,
               CASE WHEN quality IS NULL THEN confidence_score WHEN doc_id % 2 = 0 THEN 0.125
                    ELSE (quality + 0.25)::DOUBLE END AS confidence_score
        FROM catalog""",
    "propose_cluster": f"""WITH {CATALOG}
        SELECT file_path, cluster_id,
               CASE WHEN quality = 1 THEN 'next' ELSE proposed_cluster_id END AS proposed_cluster_id
        FROM catalog""",
    "deny_folder": f"""WITH {CATALOG}
        SELECT file_path, CASE WHEN toxic = 1 THEN 'q' || quality END AS denied_folder_path,
               CASE WHEN toxic = 1 THEN NULL ELSE proposed_cluster_id END AS proposed_cluster_id
        FROM catalog""",
    "rename_paths": f"""WITH {CATALOG}
        , wanted AS (
            SELECT file_path, CASE WHEN doc_id % 5 = 0 THEN 'src0/0.txt'
                                   ELSE 'renamed/' || (doc_id // 2) || '.txt' END AS new_path
            FROM labelled WHERE quality = 1),
        done AS (
            SELECT min(file_path) AS file_path, new_path FROM wanted
            WHERE new_path NOT IN (SELECT file_path FROM catalog) GROUP BY new_path)
        SELECT coalesce(new_path, file_path) AS file_path, filename, checksum
        FROM catalog LEFT JOIN done USING (file_path)""",
    "rename_files": f"""WITH {CATALOG},
        wanted AS (
            SELECT file_path, source, filename,
                   CASE WHEN quality = 1 THEN doc_id + 20 WHEN toxic = 1 THEN doc_id
                        ELSE doc_id % 60 + 10000000 END || '.txt' AS new_name
            FROM labelled),
        done AS (
            SELECT min(file_path) AS file_path, new_name, source || '/' || new_name AS new_path
            FROM wanted
            WHERE new_name <> filename
              AND source || '/' || new_name NOT IN (SELECT file_path FROM catalog)
            GROUP BY source, new_name)
        SELECT coalesce(new_path, file_path) AS file_path, coalesce(new_name, filename) AS filename,
               checksum
        FROM catalog LEFT JOIN done USING (file_path)""",
    "invalidate_embeddings": """
        SELECT vec_id AS doc_id, true AS emptied, len(embedding)::INTEGER AS kept_width
        FROM embeddings""",
    "reassign_all": f"""WITH {CATALOG},
        clusters AS (SELECT quality, avg(toxic) AS s FROM labels GROUP BY quality)
        SELECT file_path, 'c' || quality AS cluster_id, round(coalesce(s, 0.0), 6) AS confidence_score,
               'c' || quality AS proposed_cluster_id
        FROM catalog LEFT JOIN clusters USING (quality)""",
    "purge_stale": f"""WITH {CATALOG}
        SELECT file_path, checksum FROM catalog WHERE quality IS NOT NULL""",
    "catalog_diff": f"""WITH {CATALOG}
        SELECT file_path, 'removed' AS status FROM catalog WHERE quality IS NULL
        UNION ALL SELECT 'bench/' || item_id || '.txt', 'new' FROM benchmark""",
    "incremental_analyze": f"""WITH {CATALOG}
        SELECT file_path, sha256(CASE WHEN toxic = 1 THEN text || '!' ELSE text END) AS checksum,
               cluster_id, confidence_score,
               CASE WHEN quality = 1 AND toxic = 0 THEN 'reused' ELSE 'renewed' END AS status
        FROM catalog""",
    "classify_incoming": f"""WITH {FILES}, offered AS (
            SELECT item_id, (item_id * 17) || '.txt' AS filename FROM benchmark)
        SELECT item_id, filename,
               CASE WHEN filename IN (SELECT filename FROM files WHERE source <> 'src0') THEN 'tracked'
                    WHEN filename IN (SELECT (conv_id * 3) || '.txt' FROM conversations) THEN 'waiting'
                    ELSE 'new' END AS status
        FROM offered""",
    "supported_files": f"WITH {PATHS} SELECT page_id, path FROM paths WHERE {_supported('path')}",
    "excluded_paths": f"WITH {PATHS} SELECT page_id, {_excluded('path')} AS excluded FROM paths",
    "clean_folder_names": """
        SELECT page_id, coalesce(nullif(trim(regexp_replace(url, '[<>:"/\\\\|?*]', '', 'g'), '. '), ''),
                                 'Uncategorized') AS name
        FROM pages""",
    "search_documents": f"""WITH {FILES}
        SELECT doc_id FROM files
        WHERE contains(lower(filename), 'nder') OR contains(lower(text), 'nder')""",
    "search_by_index": f"""WITH {FILES}
        SELECT query, doc_id FROM files JOIN (VALUES ('  NDer ', 'nder'), ('Un', 'un'), ('é', 'é'), ('3.txt', '3.txt'),
            ('the and of', 'the and of'), ('no such passage', 'no such passage')) q(query, low)
        ON contains(lower(filename), low) OR contains(lower(text), low) OR contains('text', low)""",
    "pending_documents": """
        SELECT source, count(*) AS waiting FROM documents
        WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) GROUP BY source""",
    "highlight_documents": """
        SELECT doc_id, CASE WHEN contains(lower(text), 'eau') THEN 1.0 ELSE 0.15 END::DOUBLE AS opacity
        FROM documents""",
    "folder_lookup": """
        SELECT doc_id, CASE WHEN quality = 1 THEN 'Good/Texts' ELSE 'Uncategorized' END AS folder
        FROM documents LEFT JOIN labels USING (doc_id)""",
    "library_rows": f"""WITH {CATALOG}
        SELECT filename, printf('%.1f KB', file_size / 1024) AS size,
               strftime(modification_date, '%Y-%m-%d %H:%M') AS modified,
               filename || ' (' || CASE WHEN quality = 1 THEN 'Good/Texts' ELSE 'Uncategorized' END
               || ')' AS label
        FROM catalog""",
    "library": f"""WITH {CATALOG}, placed AS (
            SELECT filename, CASE WHEN quality = 1 THEN 'Good/Texts' ELSE '[Uncategorized]' END
                AS folder FROM catalog)
        SELECT folder, filename, count(*) OVER (PARTITION BY folder) AS files FROM placed""",
    "preview": f"""WITH {FILES}
        SELECT source AS folder, count(*) AS files, min(filename) AS first_file
        FROM files GROUP BY source""",
    "run_summary": """
        SELECT count(DISTINCT quality) AS clusters, count(*) AS files
        FROM labels JOIN documents USING (doc_id)""",
    "showing_counts": f"""WITH {FILES}
        SELECT count(*) FILTER (contains(lower(text), 'tion')) AS shown, count(*) AS total,
               count(*) FILTER (doc_id NOT IN (SELECT vec_id FROM embeddings)) AS waiting
        FROM files""",
    "map_layer": """WITH p AS (
            SELECT vec_id, 'f' || label AS folder, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y
            FROM embeddings)
        SELECT 'File' AS type, 'v' || vec_id AS label, folder, round(x, 6) AS x, round(y, 6) AS y,
               10 AS size, 1.0::DOUBLE AS opacity FROM p
        UNION ALL SELECT 'Folder', folder, folder, round(avg(x), 6), round(avg(y), 6), 30, 0.8
        FROM p GROUP BY folder""",
    "folder_colours": """WITH f AS (SELECT DISTINCT lang || '/' || source AS folder FROM documents)
        SELECT folder, ((row_number() OVER (ORDER BY folder) - 1) % 15)::INTEGER AS colour FROM f""",
    "document_tokens": f"""WITH {TOKENS}
        SELECT doc_id, len(words)::BIGINT AS n, sha256(array_to_string(words, ' ')) AS digest
        FROM tokens""",
    "word_pairs": f"""WITH {TERMS}
        SELECT doc_id, len(terms)::BIGINT AS n, sha256(array_to_string(terms, ',')) AS digest
        FROM terms""",
    "copy_groups": f"WITH {BAGS} SELECT doc_id, rep, n FROM copies",
    "tfidf_vectors": f"WITH {TOKENS}, {VECTORS} SELECT doc_id, term, round(w, 6) AS w FROM vectors",
    "group_tfidf": f"""WITH {FAMILY_WEIGHTS}
        SELECT family, grp, term, round(w, 6) AS w FROM group_weights""",
    "df_boost": f"""WITH {BOOSTED}
        SELECT family, grp, term, round(score, 6) AS score FROM boosted""",
    "df_boost_bounded": f"""WITH {BOOSTED_FREQUENT}
        SELECT family, grp, term, round(score, 6) AS score FROM boosted""",
    "contrast_terms": f"""WITH {BOOSTED}
        SELECT family, grp, string_agg(term, ',' ORDER BY r) AS ranked
        FROM (
            SELECT *, row_number() OVER (
                PARTITION BY family, grp ORDER BY round(score, 12) DESC, term DESC) AS r
            FROM boosted
            WHERE split_part(term, ' ', 1) IS DISTINCT FROM split_part(term, ' ', 2))
        WHERE r <= 6 GROUP BY family, grp""",
    "extract_keywords": f"""WITH {KEYWORDS}
        SELECT cluster_id, string_agg(term, ',' ORDER BY r) AS keywords
        FROM (SELECT * FROM alone_ranked UNION ALL SELECT * FROM shared_ranked)
        WHERE r <= 5 GROUP BY cluster_id""",
    "unique_sibling_labels": """
        SELECT lang AS family, doc_id AS grp,
               CASE WHEN lang <> 'de' AND k > 1 THEN source || '_' || (k - 1) ELSE source END AS name
        FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS k
              FROM documents)""",
    "parent_words_dropped": f"""WITH {TOKENS}, parts AS (
            SELECT doc_id, ws AS name, [w FOR w IN ws IF len(w) % 2 = 0] AS parent
            FROM (SELECT doc_id, list_sort(list_distinct(words)) AS ws FROM tokens)),
        rest AS (
            SELECT *, [w FOR w IN name IF NOT list_contains(parent, w)] AS kept FROM parts)
        SELECT doc_id, sha256(array_to_string(
            [upper(w[1]) || w[2:] FOR w IN CASE WHEN len(kept) = 0 THEN name ELSE kept END], '_'))
            AS name
        FROM rest""",
    "cosine_similarities": """
        SELECT a.vec_id AS doc_id,
               round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim
        FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "similarity_join": f"WITH {REP_PAIRS} SELECT src, dst, round(sim, 6) AS sim FROM pairs",
    "similarity_join_blocked": f"WITH {REP_PAIRS} SELECT src, dst, round(sim, 6) AS sim FROM pairs",
    "similarity_links_blocked": f"""WITH RECURSIVE {REP_PAIRS}, {_components("pairs", "comp")}
        SELECT doc_id, grp FROM comp""",
    "dense_pairs_blocked": f"""WITH {DENSE}
        SELECT src, dst, round(sim, 6) AS sim FROM dense_pairs WHERE sim >= 0.35""",
    "similarity_join_dense": f"""WITH {DENSE}
        SELECT src, dst, round(sim, 6) AS sim FROM dense_pairs WHERE sim >= 0.35""",
    "document_groups": f"""WITH RECURSIVE {REP_PAIRS},
        {_components("pairs", "comp")},
        grouped AS (
            SELECT c.doc_id, c.rep,
                   coalesce(k.grp, CASE WHEN c.n > 1 THEN c.rep END) AS grp
            FROM copies c LEFT JOIN comp k ON k.doc_id = c.rep),
        placed AS (SELECT * FROM grouped WHERE grp IS NOT NULL),
        sums AS (
            SELECT grp, sum(s * s) AS squares FROM (
                SELECT grp, term, sum(w) AS s FROM placed p JOIN reps r ON r.doc_id = p.rep
                GROUP BY grp, term) GROUP BY grp)
        SELECT doc_id, grp, size, round((squares - size) / (size * (size - 1)), 6)
            AS average_similarity
        FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS size FROM placed) JOIN sums USING (grp)""",
    "density_groups": f"WITH RECURSIVE {DENSE_GROUPS} SELECT doc_id, grp FROM comp",
    "assign_noise": f"""WITH RECURSIVE {DENSE_GROUPS},
        sums AS (
            SELECT grp, i, avg(v[i]) AS m
            FROM (SELECT grp, v, unnest(range(1, len(v) + 1)) AS i FROM dense_grouped
                  WHERE grp IS NOT NULL) GROUP BY grp, i),
        means AS (SELECT grp, list(m ORDER BY i) AS m FROM sums GROUP BY grp),
        sims AS (
            SELECT d.doc_id, m.grp, list_cosine_similarity(d.v, m.m) AS sim
            FROM dense_grouped d, means m WHERE d.grp IS NULL),
        best AS (
            SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sim DESC, grp) AS r FROM sims)
        SELECT doc_id, grp FROM best WHERE r = 1 AND sim >= 0.30""",
    "regroup_noise": f"""WITH RECURSIVE {DENSE_GROUPS},
        noise AS (SELECT doc_id FROM dense_grouped WHERE grp IS NULL),
        loose_pairs AS (
            SELECT src, dst FROM dense_pairs WHERE sim >= 0.30
            AND src IN (SELECT doc_id FROM noise) AND dst IN (SELECT doc_id FROM noise)),
        {_components("loose_pairs", "loose")}
        SELECT doc_id, coalesce(grp, doc_id) AS grp,
               CASE WHEN grp IS NULL THEN 2 ELSE 1 END AS kind
        FROM noise LEFT JOIN loose USING (doc_id)""",
    "cluster_stats_dense": f"""WITH {DENSE}
        SELECT a.label AS cluster_id, sqrt(count(*))::BIGINT AS size,
               CASE WHEN count(*) = 1 THEN 1.0 ELSE round(
                   sum(CASE WHEN a.doc_id <> b.doc_id THEN list_cosine_similarity(a.v, b.v) ELSE 0 END)
                   / (count(*) - sqrt(count(*))), 6) END AS average_similarity
        FROM vec a JOIN vec b ON a.label = b.label GROUP BY a.label""",
    "cluster_stats": f"""WITH {TOKENS}, {VECTORS},
        sizes AS (SELECT source, count(*) AS size FROM documents GROUP BY source),
        sums AS (
            SELECT source, term, sum(w) AS s, sum(w * w) AS q
            FROM vectors JOIN documents USING (doc_id) GROUP BY source, term)
        SELECT source AS cluster_id, any_value(size) AS size,
               round((sum(s * s) - sum(q)) / (any_value(size) * (any_value(size) - 1)), 6)
                   AS average_similarity
        FROM sums JOIN sizes USING (source) GROUP BY source""",
    "cluster_centroids": f"""WITH {DENSE}
        SELECT label, (i - 1)::BIGINT AS pos, round(avg(v[i]), 6) AS value
        FROM (SELECT label, v, unnest(range(1, len(v) + 1)) AS i FROM vec) GROUP BY label, i""",
    "apply_denials": f"WITH {ASSIGNED} SELECT doc_id, folder FROM approved",
    "removed_clusters": """
        SELECT DISTINCT lang || '-' || source AS cluster_id FROM documents
        EXCEPT SELECT lang || '-' || source FROM documents JOIN labels USING (doc_id)""",
    "unclustered_to_root": f"""WITH {ASSIGNED}
        SELECT doc_id, '.' AS folder FROM files WHERE doc_id NOT IN (SELECT doc_id FROM approved)""",
    "move_plan": f"""WITH {FILES}, {TWINS},
        existing AS (
            SELECT file_path FROM files UNION SELECT file_path FROM twins
            UNION SELECT doc_id || '.txt' FROM labels WHERE toxic = 1),
        moves AS (
            SELECT file_path AS source_path,
                   CASE doc_id % 5 WHEN 0 THEN source WHEN 1 THEN '.'
                        ELSE 'src' || ((doc_id + 20) % 7) END AS target_folder FROM files
            UNION ALL SELECT 'old/' || item_id || '.txt', 'src1' FROM benchmark
            UNION ALL SELECT file_path, 'twins' FROM twins),
        wanted AS (
            SELECT *, regexp_extract(source_path, '[^/]*$') AS name,
                   regexp_replace(source_path, '/?[^/]*$', '') AS folder FROM moves),
        dest AS (
            SELECT *, CASE WHEN target_folder = '.' THEN name ELSE target_folder || '/' || name END
                AS destination_path FROM wanted),
        judged AS (
            SELECT *, CASE WHEN source_path NOT IN (SELECT file_path FROM existing) THEN 'missing'
                WHEN folder = CASE WHEN target_folder = '.' THEN '' ELSE target_folder END
                    THEN 'in place'
                WHEN destination_path IN (SELECT file_path FROM existing) THEN 'taken'
                ELSE 'move' END AS status FROM dest)
        SELECT source_path, target_folder, destination_path,
               CASE WHEN status = 'move' AND row_number() OVER (
                   PARTITION BY destination_path, status ORDER BY source_path) > 1
                   THEN 'taken' ELSE status END AS status
        FROM judged""",
    "integrity_audit": f"""WITH {CATALOG}, checked AS (
            SELECT file_path AS source_path, 'new/' || filename AS destination_path,
                   sha256(text) AS checksum_before,
                   CASE WHEN quality = 1 THEN
                       sha256(CASE WHEN toxic = 1 THEN text || 'x' ELSE text END) END AS checksum_after
            FROM labelled)
        SELECT 'move' AS operation_type, *,
               checksum_before IS NOT DISTINCT FROM checksum_after AS success,
               CASE WHEN checksum_before IS DISTINCT FROM checksum_after
                    THEN 'Checksum mismatch after move' END AS error_message
        FROM checked""",
    "folder_plan": f"""WITH {CATALOG}
        SELECT DISTINCT 'q' || quality || '/' || lang AS folder, 'create' AS action FROM labelled
        UNION ALL
        SELECT source, 'delete' FROM files GROUP BY source HAVING bool_and(lang <> 'es')""",
    "unique_destinations": f"""WITH {CATALOG},
        taken AS (
            SELECT DISTINCT lang, doc_id % 50 AS number FROM labelled WHERE doc_id % 50 > 0),
        wanted AS (
            SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS k
            FROM files),
        free AS (
            SELECT lang, number, row_number() OVER (PARTITION BY lang ORDER BY number) AS k
            FROM (SELECT lang, unnest(range(1, count(*) + 51)) AS number FROM files GROUP BY lang)
            ANTI JOIN taken USING (lang, number))
        SELECT doc_id, lang || '/note.txt' AS path,
               lang || '/note' || coalesce('_' || number, '') || '.txt' AS destination
        FROM wanted LEFT JOIN free USING (lang, k)""",
    "recent_operations": f"""WITH {OPERATIONS}
        SELECT operation_id, timestamp, operation_type FROM operations
        ORDER BY timestamp DESC, operation_id DESC LIMIT 100""",
    "undo_plan": f"""WITH {OPERATIONS},
        newest AS (SELECT * FROM operations ORDER BY timestamp DESC, operation_id DESC LIMIT 120)
        SELECT operation_id, destination_path AS source_path,
               CASE WHEN user_id % 3 = 0 THEN '' ELSE regexp_extract(source_path, '^[^/]*') || '/' END
               || regexp_extract(destination_path, '[^/]*$') AS destination_path
        FROM newest
        WHERE operation_type = 'move' AND success AND source_path IS NOT NULL
          AND destination_path IN (SELECT destination_path FROM operations WHERE value > 8)
        ORDER BY timestamp DESC, newest.operation_id DESC LIMIT 40""",
    "normalize_changes": f"""WITH {CHANGES}, {NORMALIZED}
        SELECT event_id, action, path FROM normalized""",
    "suppress_own_changes": f"""WITH {CHANGES}
        SELECT event_id FROM changes
        WHERE path NOT IN (SELECT path FROM changes WHERE kind = 'moved')""",
    "changes_while_running": """
        SELECT event_id FROM events e WHERE NOT EXISTS (
            SELECT 1 FROM events s WHERE s.event_type = 'signup'
            AND e.ts >= s.ts AND e.ts < s.ts + INTERVAL 10 MINUTE)""",
    "cooldown": """
        SELECT event_id FROM events e WHERE NOT EXISTS (
            SELECT 1 FROM events s WHERE s.event_type = 'signup'
            AND e.ts >= s.ts AND e.ts < s.ts + INTERVAL 300 SECOND)""",
    "debounce": f"""WITH {CHANGES}, {NORMALIZED},
        marked AS (
            SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS begins
            FROM normalized WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        numbered AS (
            SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM marked)
        SELECT user_id, min(ts) AS session, max(ts) AS last,
               count(DISTINCT path) FILTER (action = 'changed') AS changed,
               count(DISTINCT path) FILTER (action = 'deleted') AS deleted
        FROM numbered GROUP BY user_id, s""",
    "apply_changes": f"""WITH {CATALOG}
        SELECT file_path, sha256(CASE WHEN quality IS NULL THEN text ELSE text || '?' END) AS checksum,
               cluster_id, confidence_score, CASE WHEN quality IS NULL THEN 1.0 ELSE 2.0 END::DOUBLE
               AS mark
        FROM catalog WHERE coalesce(toxic, 0) <> 1""",
}
