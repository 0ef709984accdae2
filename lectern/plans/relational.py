"""The SQL surface: statements that go through the read-only gate, with the same text (or a second one, where dialects differ) for a comparison engine."""

from __future__ import annotations

MONEY = "CAST(sum(CAST({} AS DECIMAL(18,2))) AS DOUBLE)"


def _sum(c: str) -> str:
    return MONEY.format(c)


REVENUE = "CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE)"


#: name -> statement
SAME = {
    "join_inner": f"SELECT n_name, count(*) AS n_orders, {_sum('o_totalprice')} AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "join_left": "SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY c_custkey",
    "join_right": "SELECT s_suppkey, count(l_orderkey) AS n_lines FROM lineitem RIGHT JOIN supplier ON l_suppkey = s_suppkey AND l_quantity > 45 GROUP BY s_suppkey",
    "join_full": "SELECT a.doc_id AS document_id, b.doc_id AS label_id, b.quality AS quality FROM (SELECT doc_id FROM documents WHERE lang <> 'en') a FULL OUTER JOIN (SELECT doc_id, quality FROM labels) b ON a.doc_id = b.doc_id",
    "join_cross": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "join_semi": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
    "join_anti": "SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R')",
    "join_theta": "SELECT a.s_suppkey AS low, b.s_suppkey AS high FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal",
    "join_self": "SELECT a.conv_id AS conv_id, a.turn AS turn, a.role AS role, b.role AS next_role FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1",
    "join_natural": "SELECT item_id, n FROM (SELECT item_id, length(text) AS n FROM benchmark) a NATURAL JOIN (SELECT item_id FROM benchmark WHERE length(text) > 150) b",
    "join_using": "SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id)",
    "agg_group": f"SELECT l_returnflag, l_linestatus, count(*) AS n, {_sum('l_quantity')} AS quantity, {_sum('l_extendedprice')} AS price, round(avg(l_discount), 6) AS discount FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "agg_distinct": "SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderpriority",
    "agg_having": f"SELECT o_custkey, count(*) AS n, {_sum('o_totalprice')} AS total FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "agg_filter": "SELECT event_type, count(*) FILTER (WHERE value > 10) AS high, count(*) FILTER (WHERE value <= 10) AS low FROM events GROUP BY event_type",
    "agg_cond_count": "SELECT lang, CAST(sum(CASE WHEN n_chars > 2048 THEN 1 ELSE 0 END) AS BIGINT) AS long_texts, count(*) AS n FROM documents GROUP BY lang",
    "agg_minmax": "SELECT source, min(n_chars) AS shortest, max(n_chars) AS longest, count(text) AS n FROM documents GROUP BY source",
    "agg_rollup": f"SELECT l_returnflag, l_linestatus, count(*) AS n, {_sum('l_quantity')} AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "agg_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "agg_grouping_sets": "SELECT lang, source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source), ())",
    "win_rank": "SELECT c_custkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER w AS BIGINT) AS rk, CAST(dense_rank() OVER w AS BIGINT) AS dr FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_mktsegment, c_custkey)",
    "win_ntile": "SELECT s_suppkey, CAST(ntile(4) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS BIGINT) AS quarter, round(percent_rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey), 6) AS pr, round(cume_dist() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey), 6) AS cd FROM supplier",
    "win_lag_lead": "SELECT event_id, lag(event_type) OVER w AS before, lead(event_type) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "win_first_last": "SELECT o_orderkey, first_value(o_orderkey) OVER w AS first_key, last_value(o_orderkey) OVER w AS last_key, nth_value(o_orderkey, 2) OVER w AS second_key FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "win_rows_frame": "SELECT event_id, CAST(sum(CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE) AS moving FROM events",
    "win_groups_frame": "SELECT doc_id, count(*) OVER (PARTITION BY lang ORDER BY n_chars GROUPS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS n, CAST(sum(doc_id) OVER (ORDER BY source DESC GROUPS 1 PRECEDING) AS BIGINT) AS s, min(n_chars) OVER (PARTITION BY lang ORDER BY source GROUPS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM documents WHERE n_chars > 10",
    "win_exclude": "SELECT doc_id, CAST(sum(n_chars) OVER (PARTITION BY lang ORDER BY source GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW EXCLUDE GROUP) AS BIGINT) AS others, count(*) OVER (ORDER BY lang RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE TIES) AS n, max(n_chars) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING EXCLUDE CURRENT ROW) AS around, round(avg(n_chars) OVER (PARTITION BY lang ORDER BY source GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE CURRENT ROW), 4) AS mean, min(n_chars) OVER (PARTITION BY source ORDER BY lang GROUPS BETWEEN CURRENT ROW AND 1 FOLLOWING EXCLUDE CURRENT ROW) AS least_other FROM documents d",
    "win_range_frame": "SELECT doc_id, count(*) OVER (PARTITION BY lang ORDER BY n_chars RANGE BETWEEN 100 PRECEDING AND 100 FOLLOWING) AS like_length FROM documents",
    "setop_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier",
    "setop_union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey AS k FROM supplier",
    "setop_intersect": "SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels WHERE quality = 1",
    "setop_except": "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels",
    "cte_chain": f"WITH big AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 200000), spent AS (SELECT o_custkey, {_sum('o_totalprice')} AS total FROM big GROUP BY o_custkey) SELECT c_name, total FROM spent JOIN customer ON c_custkey = o_custkey",
    "cte_recursive": "WITH RECURSIVE days(d) AS (SELECT 1 UNION ALL SELECT d + 1 FROM days WHERE d < 30) SELECT CAST(d AS BIGINT) AS d, count(event_id) AS n FROM days LEFT JOIN events ON day(ts) = d GROUP BY d",
    "correlated_exists": "SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 49)",
    "scalar_subquery": "SELECT s_suppkey, s_acctbal FROM supplier s WHERE s_acctbal > (SELECT avg(s_acctbal) FROM supplier t WHERE t.s_nationkey = s.s_nationkey)",
    "values_case_limit": "SELECT n_name, k, CASE WHEN k > 2 THEN 'high' ELSE 'low' END AS side FROM (VALUES (1), (2), (3), (4)) AS v(k) JOIN nation ON n_regionkey = k ORDER BY k, n_name LIMIT 12",
    "fn_string": "SELECT p_partkey, upper(p_name) AS u, substring(p_name, 2, 3) AS s, length(p_type) AS n, replace(p_brand, '#', '-') AS b, concat(p_brand, '/', p_type) AS c, trim(concat('  ', p_name, ' ')) AS t, lpad(CAST(p_size AS VARCHAR(10)), 4, '0') AS l FROM part",
    "fn_date": "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(day(o_orderdate) AS BIGINT) AS d, CAST(quarter(o_orderdate) AS BIGINT) AS q, CAST(extract(DOY FROM o_orderdate) AS BIGINT) AS doy FROM orders",
    "fn_math": "SELECT p_partkey, abs(p_size - 25) AS a, CAST(floor(p_retailprice / 7) AS BIGINT) AS f, CAST(ceil(p_retailprice / 7) AS BIGINT) AS c, round(sqrt(p_retailprice), 6) AS r, p_size % 7 AS m, round(ln(p_retailprice), 6) AS l, round(power(p_size, 2), 6) AS p FROM part",
    "fn_case_cast": "SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 0 END AS code, CAST(l_quantity AS INTEGER) AS q, coalesce(nullif(l_linestatus, 'F'), 'none') AS st FROM lineitem",
    "keyword_search_any": "SELECT doc_id FROM documents WHERE text ILIKE '%license%' OR text ILIKE '%worthless%'",
    "order_limit_offset": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5",
    "tpch_pricing": f"SELECT l_returnflag, l_linestatus, {REVENUE} AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
    "tpch_revenue": f"SELECT n_name, {REVENUE} AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name",
}

#: name -> (Spark's statement, the other engine's)
BOTH = {
    "json_extract_props": ("SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events"),
    "list_by_group": ("SELECT conv_id, listagg(role, '; ') WITHIN GROUP (ORDER BY turn) AS roles FROM conversations GROUP BY conv_id", "SELECT conv_id, string_agg(role, '; ' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id"),
    "null_order": (
        "SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY nullif(p_size, 1), p_partkey) AS BIGINT) AS rn FROM part",
        "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY nullif(p_size, 1) NULLS FIRST, p_partkey) AS rn FROM part",
    ),
    "integer_division": ("SELECT p_partkey, CAST(p_size div 2 AS BIGINT) AS half, try_divide(p_size, p_size - 10) AS q FROM part", "SELECT p_partkey, CAST(p_size // 2 AS BIGINT) AS half, CASE WHEN p_size = 10 THEN NULL ELSE p_size / (p_size - 10) END AS q FROM part"),
    "collate_nocase": ("SELECT p_brand COLLATE UTF8_LCASE = lower(p_brand) AS same, count(*) AS n FROM part GROUP BY 1", "SELECT p_brand COLLATE NOCASE = lower(p_brand) AS same, count(*) AS n FROM part GROUP BY 1"),
    "other_names": (
        "SELECT conv_id, group_concat(iif(turn > 1, upper(role), role), ',') AS roles, total(CASE WHEN turn > 99 THEN turn END) AS none, iif(count(*) > 2, 1, 0) AS long, 'total(x)' AS kept FROM (SELECT * FROM conversations WHERE turn < 1) GROUP BY conv_id",
        "SELECT conv_id, string_agg(CASE WHEN turn > 1 THEN upper(role) ELSE role END, ',') AS roles, 0::DOUBLE AS none, 0 AS long, 'total(x)' AS kept FROM conversations WHERE turn < 1 GROUP BY conv_id",
    ),
    "strftime_names": ("SELECT event_id, strftime('%Y/%m-%d', ts) AS day, CAST(julianday(CAST(ts AS TIMESTAMP)) * 10 AS BIGINT) AS tenth FROM events", "SELECT event_id, strftime(ts, '%Y/%m-%d') AS day, CAST(floor((epoch(ts) / 86400.0 + 2440587.5) * 10) AS BIGINT) AS tenth FROM events"),
    "json_each_props": ("SELECT e.event_id, j.key, j.value FROM events e, LATERAL json_each(e.props) j", "SELECT event_id, k AS key, json_extract_string(props, '$.\"' || k || '\"') AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)"),
    "vector_functions": ("SELECT vec_id, vec_length(CAST(embedding AS ARRAY<DOUBLE>)) AS n, substring(vec_to_json(array(1.5D, CAST(vec_id AS DOUBLE))), 1, 5) AS j FROM embeddings", "SELECT vec_id, len(embedding)::INT AS n, '[1.5,' AS j FROM embeddings"),
}
