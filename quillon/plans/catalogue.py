"""The registered queries of the relational operators and the SQL they are held against.

Each query is text of the language over the tables of a folder; its last line is the result.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon import display
from quillon.session import Session
from quillon.sources import tables
from quillon.sources.tables import shared_dir

#: Keys of the tables. lineitem has none, but its rows are distinct.
KEYS = {
    "region": ["r_regionkey"],
    "nation": ["n_nationkey"],
    "customer": ["c_custkey"],
    "supplier": ["s_suppkey"],
    "part": ["p_partkey"],
    "orders": ["o_orderkey"],
    "lineitem": None,
    "events": ["event_id"],
    "labels": ["doc_id"],
    "benchmark": ["item_id"],
    "conversations": ["conv_id", "turn"],
}

#: name -> (statements, SQL)
CATALOGUE: dict[str, tuple[str, str]] = {
    "q_flagship": (
        """orders @ [o_custkey c_custkey] *. customer /. c_mktsegment [n: #. total: +. o_totalprice ~ 2]""",
        """SELECT c_mktsegment, count(*) AS n, CAST(round(sum(o_totalprice), 2) AS DECIMAL(38, 2)) AS total
           FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment""",
    ),
    "q_filter_project": (
        "orders ? o_totalprice > 200000 # o_custkey",
        "SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 200000",
    ),
    "q_negated_or": (
        'orders ?! (o_orderstatus = "F" | o_totalprice < 100000) # [o_orderkey o_orderstatus]',
        "SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice < 100000)",
    ),
    "q_chained_filter": (
        'customer ? c_acctbal > 0 ? c_mktsegment = "BUILDING" # [c_custkey c_name]',
        "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0 AND c_mktsegment = 'BUILDING'",
    ),
    "q_remove": (
        "orders #! [o_orderkey o_totalprice o_orderdate o_custkey]",
        "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    ),
    "q_rename_swap": (
        "nation @ [n_nationkey n_regionkey n_regionkey n_nationkey]",
        "SELECT CAST(n_nationkey AS BIGINT) AS n_regionkey, n_name, CAST(n_regionkey AS BIGINT) AS n_nationkey FROM nation",
    ),
    "q_extend_arith": (
        "part # [p_partkey p_size p_retailprice] +: [twice: p_size * 2 + 1 net: p_retailprice * 0.9 ~ 2]",
        """SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size, p_retailprice,
                  CAST(p_size AS BIGINT) * 2 + 1 AS twice, CAST(round_even(p_retailprice * 0.9::DOUBLE, 2) AS DECIMAL(38, 2)) AS net
           FROM part""",
    ),
    "q_floor_mod": (
        "part # [p_partkey p_size] +: s: p_size - 25 +: [f: s // 7 m: s % 7 g: s // -7 k: s % -7]",
        """WITH x AS (SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size, CAST(p_size AS BIGINT) - 25 AS s FROM part)
           SELECT *, CAST(floor(s / 7.0) AS BIGINT) AS f, s - 7 * CAST(floor(s / 7.0) AS BIGINT) AS m,
                  CAST(floor(s / -7.0) AS BIGINT) AS g, s + 7 * CAST(floor(s / -7.0) AS BIGINT) AS k FROM x""",
    ),
    "q_modify_dedupe": (
        "lineitem # [l_quantity l_linestatus] =: l_quantity: l_quantity // 10",
        "SELECT DISTINCT floor(l_quantity / 10) AS l_quantity, l_linestatus FROM lineitem",
    ),
    "q_natural_join_3way": (
        "nation @ [n_regionkey r_regionkey] *. region @ [n_nationkey c_nationkey] *. customer # [c_custkey n_name r_name]",
        """SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey
           JOIN region ON n_regionkey = r_regionkey""",
    ),
    "q_cartesian": (
        "region # r_name *. (customer # c_mktsegment)",
        "SELECT r_name, c_mktsegment FROM (SELECT DISTINCT r_name FROM region) CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer)",
    ),
    "q_same_heading_join": (
        "orders ? o_totalprice > 150000 *. (orders ? o_orderstatus = \"O\") # o_orderkey",
        "SELECT o_orderkey FROM orders WHERE o_totalprice > 150000 AND o_orderstatus = 'O'",
    ),
    "q_theta_join": (
        "region @ [r_regionkey a r_name x] *. (region @ [r_regionkey b r_name y]) ? a < b # [x y]",
        "SELECT p.r_name AS x, q.r_name AS y FROM region p JOIN region q ON p.r_regionkey < q.r_regionkey",
    ),
    "q_left_join_default": (
        """spent := orders /. o_custkey [n: #. most: >. o_totalprice] @ [o_custkey c_custkey]
customer # [c_custkey c_name] *< spent [n: 0 most: 0.0]""",
        """SELECT c_custkey, c_name, coalesce(n, 0) AS n, coalesce(most, 0.0) AS most FROM customer LEFT JOIN
           (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS most FROM orders GROUP BY 1) ON o_custkey = c_custkey""",
    ),
    "q_nest_join_count": (
        """mine := orders # [o_custkey o_orderkey] @ [o_custkey c_custkey]
customer # c_custkey *: mine: mine +: n: #. mine #! mine""",
        """SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""",
    ),
    "q_nest_unnest": (
        "nation /: members: n_regionkey <: members",
        "SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey, n_name, CAST(n_nationkey AS BIGINT) AS n_nationkey FROM nation",
    ),
    "q_nest_by_aggregates": (
        "customer # [c_custkey c_nationkey c_acctbal] /: team: c_nationkey +: [n: #. team top: >. team.c_acctbal low: <. team.c_acctbal rich: #. (team ? c_acctbal > 5000)] #! team",
        """SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, count(*) AS n, max(c_acctbal) AS top, min(c_acctbal) AS low,
                  count(*) FILTER (c_acctbal > 5000) AS rich FROM customer GROUP BY 1""",
    ),
    "q_nested_filter": (
        "orders # [o_orderkey o_custkey] /: mine: o_custkey ? #. mine > 15 # o_custkey",
        "SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 15",
    ),
    "q_summarize": (
        "lineitem /. [l_returnflag l_linestatus] [n: #. qty: +. l_quantity ~ 2 price: %. l_extendedprice ~ 2 most: >. l_discount]",
        """SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(round(sum(l_quantity), 2) AS DECIMAL(38, 2)) AS qty,
                  CAST(round_even(avg(l_extendedprice), 2) AS DECIMAL(38, 2)) AS price, max(l_discount) AS most
           FROM lineitem GROUP BY 1, 2""",
    ),
    "q_summarize_all": (
        "orders /. [n: #. low: <. o_totalprice high: >. o_totalprice mean: %. o_totalprice ~ 2]",
        """SELECT count(*) AS n, min(o_totalprice) AS low, max(o_totalprice) AS high,
                  CAST(round_even(avg(o_totalprice), 2) AS DECIMAL(38, 2)) AS mean FROM orders""",
    ),
    "q_summarize_empty": (
        "orders ? o_totalprice < 0 /. [n: #. total: +. o_totalprice]",
        "SELECT count(*) AS n, coalesce(sum(o_totalprice), 0) AS total FROM orders WHERE o_totalprice < 0",
    ),
    "q_agg_of_agg": (
        "lineitem /. l_returnflag [net: (+. l_extendedprice / #.) ~ 2 spread: (>. l_quantity - <. l_quantity)]",
        """SELECT l_returnflag, CAST(round_even(sum(l_extendedprice) / count(*), 2) AS DECIMAL(38, 2)) AS net,
                  max(l_quantity) - min(l_quantity) AS spread FROM lineitem GROUP BY 1""",
    ),
    "q_auto_names": (
        "part # [p_partkey p_brand p_size] /. p_brand [#. +. p_size <. p_size >. p_size]",
        """SELECT p_brand, count(*) AS count, CAST(sum(p_size) AS BIGINT) AS sum_p_size, CAST(min(p_size) AS BIGINT) AS min_p_size,
                  CAST(max(p_size) AS BIGINT) AS max_p_size FROM part GROUP BY 1""",
    ),
    "q_count_distinct": (
        "orders # [o_custkey o_orderpriority] /. o_orderpriority [n: #.]",
        "SELECT o_orderpriority, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1",
    ),
    "q_broadcast_above_avg": (
        "customer # [c_custkey c_nationkey c_acctbal] /* c_nationkey [top: >. c_acctbal n: #.] ? c_acctbal = top",
        """SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, top, n FROM (
             SELECT *, max(c_acctbal) OVER (PARTITION BY c_nationkey) AS top, count(*) OVER (PARTITION BY c_nationkey) AS n
             FROM customer) WHERE c_acctbal = top""",
    ),
    "q_broadcast_all": (
        "supplier # [s_suppkey s_acctbal] /* [most: >. s_acctbal n: #.] +: gap: most - s_acctbal ~ 2",
        """SELECT s_suppkey, s_acctbal, max(s_acctbal) OVER () AS most, count(*) OVER () AS n,
                  CAST(round_even(max(s_acctbal) OVER () - s_acctbal, 2) AS DECIMAL(38, 2)) AS gap FROM supplier""",
    ),
    "q_percent": (
        "orders /. o_orderstatus [share: p. o_custkey ~ 3]",
        """SELECT o_orderstatus, CAST(round_even(100.0::DOUBLE * sum(o_custkey) / (SELECT sum(o_custkey) FROM orders), 3) AS DECIMAL(38, 3)) AS share
           FROM orders GROUP BY 1""",
    ),
    "q_collect": (
        "nation /. n_regionkey [names: n. n_name] +: n: #. names <: names",
        """SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey, n_name, count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation""",
    ),
    "q_rank": (
        "part # [p_partkey p_size p_brand] /^ r: [p_size- p_brand]",
        """SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size, p_brand, dense_rank() OVER (ORDER BY p_size DESC, p_brand) AS r FROM part""",
    ),
    "q_bucket": (
        "part # [p_partkey p_size] /& b: p_size- 4",
        """WITH r AS (SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size, dense_rank() OVER (ORDER BY p_size DESC) AS r FROM part)
           SELECT p_partkey, p_size, CAST(floor((r - 1) * 4 / (SELECT max(r) FROM r)) AS BIGINT) + 1 AS b FROM r""",
    ),
    "q_topk": (
        "orders # [o_orderkey o_totalprice] $ [o_totalprice- o_orderkey] ^ 10",
        "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    ),
    "q_order_columns": (
        "orders $. [o_orderpriority o_orderstatus]",
        "SELECT o_orderpriority, o_orderstatus FROM orders",
    ),
    "q_union": (
        "orders ? o_totalprice > 300000 # o_custkey |. (orders ? o_orderstatus = \"P\" # o_custkey)",
        """SELECT o_custkey FROM orders WHERE o_totalprice > 300000 UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'""",
    ),
    "q_difference": (
        "customer # c_custkey -. (orders # o_custkey @ o_custkey c_custkey)",
        "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders",
    ),
    "q_intersect": (
        "customer ? c_acctbal < 0 # c_custkey &. (orders # o_custkey @ o_custkey c_custkey)",
        "SELECT c_custkey FROM customer WHERE c_acctbal < 0 INTERSECT SELECT o_custkey FROM orders",
    ),
    "q_subquery_scalar": (
        "orders ? o_totalprice > (orders /. [m: %. o_totalprice]) # o_orderkey",
        "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)",
    ),
    "q_subquery_in": (
        "customer ? c_nationkey = (nation ? n_regionkey = 2 # n_nationkey) # c_custkey",
        "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)",
    ),
    "q_subquery_not_in": (
        "customer ? c_nationkey != (nation ? n_regionkey = 2 # n_nationkey) # c_custkey",
        "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)",
    ),
    "q_in_member": (
        "orders ? o_custkey in. (customer ? c_mktsegment = \"AUTOMOBILE\" # c_custkey) # o_orderkey",
        "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'AUTOMOBILE')",
    ),
    "q_not_member": (
        "orders ?! o_custkey in. (customer ? c_mktsegment = \"AUTOMOBILE\" # c_custkey) # o_orderkey",
        "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'AUTOMOBILE')",
    ),
    "q_member_flag": (
        "customer # [c_custkey] +: buys: ?: c_custkey in. (orders # o_custkey) \"yes\" \"no\"",
        "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'yes' ELSE 'no' END AS buys FROM customer",
    ),
    "q_set_literal": (
        "part ? p_size = {1, 5, 10} ? p_brand != {\"Brand#11\"} # [p_partkey p_size]",
        "SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part WHERE p_size IN (1, 5, 10) AND p_brand NOT IN ('Brand#11')",
    ),
    "q_regex": (
        "customer ? c_name =~ \"0[0-9]*[13579]$\" ? c_mktsegment !=~ \"^(A|B)\" # c_custkey",
        "SELECT c_custkey FROM customer WHERE regexp_matches(c_name, '0[0-9]*[13579]$') AND NOT regexp_matches(c_mktsegment, '^(A|B)')",
    ),
    "q_number_in_text": (
        "events +: d: user_id .as str ? d > 50 # [event_id]",
        "SELECT event_id FROM events WHERE user_id > 50",
    ),
    "q_substring": (
        "customer # [c_custkey c_name] +: [a: c_name .s [1 4] z: c_name .s [-3] m: c_name .s [2 -2]]",
        """SELECT c_custkey, c_name, substr(c_name, 1, 4) AS a, right(c_name, 3) AS z,
                  substr(c_name, 2, greatest(length(c_name) - 2, 0)) AS m FROM customer""",
    ),
    "q_string_ops": (
        "part # [p_partkey p_name] +: [u: p_name .s \"upper\" c: p_name .s \"cap\" n: p_name .s \"len\" t: p_name .s \"trim\"]",
        """SELECT p_partkey, p_name, upper(p_name) AS u, upper(p_name[1]) || lower(p_name[2:]) AS c,
                  CAST(length(p_name) AS BIGINT) AS n, trim(p_name) AS t FROM part""",
    ),
    "q_regex_replace": (
        "part # [p_partkey p_type] +: r: p_type .r \"([A-Z])[A-Z]+\" \"\\\\1.\"",
        "SELECT p_partkey, p_type, regexp_replace(p_type, '([A-Z])[A-Z]+', '\\1.', 'g') AS r FROM part",
    ),
    "q_format": (
        "nation # [n_nationkey n_name] +: label: \"{n_nationkey:04d}/{n_name:>16}|{n_name:<16}|\" .f",
        """SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name,
                  lpad(CAST(n_nationkey AS VARCHAR), 4, '0') || '/' || lpad(n_name, greatest(16, length(n_name))::INT, ' ') || '|'
                  || rpad(n_name, greatest(16, length(n_name))::INT, ' ') || '|' AS label FROM nation""",
    ),
    "q_format_numbers": (
        "part # [p_partkey p_retailprice p_size] +: tie: p_retailprice / 8 +: label: \"{tie:.2f} {p_retailprice:.0f} {p_size:+d} {p_size:x} {tie:,.3f} {p_size:08.1f} {p_retailprice:^+12.1f}|{p_size:_}\" .f # [p_partkey label]",
        """SELECT p_partkey, printf('%.2f %.0f %+d %x ', p_retailprice / 8, p_retailprice, p_size, p_size)
                  || format('{:,}', CAST(trunc(p_retailprice / 8) AS BIGINT)) || right(printf('%.3f', p_retailprice / 8), 4)
                  || printf(' %08.1f ', CAST(p_size AS DOUBLE))
                  || format('{:^+12.1f}', p_retailprice) || '|' || p_size AS label FROM part""",
    ),
    "q_replace_named": (
        "part # [p_partkey p_type] +: r: p_type .r \"(?P<first>[A-Z])(?P<rest_of>[A-Z]+)\" \"\\\\g<rest_of>$\\\\g<1>0\"",
        "SELECT p_partkey, p_type, regexp_replace(p_type, '([A-Z])([A-Z]+)', '\\2$\\10', 'g') AS r FROM part",
    ),
    "q_split_groups": (
        "customer # [c_custkey c_name] /> [piece at]: c_name \"(#)(0*)\"",
        """WITH s AS (SELECT c_custkey, [split_part(c_name, '#', 1), '#', regexp_extract(c_name, '#(0*)', 1),
                  regexp_replace(c_name, '^.*#0*', '')] AS p FROM customer)
           SELECT c_custkey, unnest(p) AS piece, CAST(generate_subscripts(p, 1) AS BIGINT) AS at FROM s""",
    ),
    "q_text_extremes": (
        "part # [p_partkey p_brand p_size] +: size: p_size .as str /. p_brand [most: >. size least: <. size]",
        "SELECT p_brand, CAST(max(p_size) AS VARCHAR) AS most, CAST(min(p_size) AS VARCHAR) AS least FROM part GROUP BY 1",
    ),
    "q_date_parts": (
        "orders # [o_orderkey o_orderdate] +: [y: o_orderdate .d \"year\" m: o_orderdate .d \"month\" w: o_orderdate .d \"week\" dow: o_orderdate .d \"dow\" q: o_orderdate .d \"q\" qq: o_orderdate .d \"qq\"] #! o_orderdate",
        """SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, week(o_orderdate) AS w, isodow(o_orderdate) AS dow,
                  quarter(o_orderdate) AS q, 'Q' || quarter(o_orderdate) AS qq FROM orders""",
    ),
    "q_date_format": (
        "orders # [o_orderkey o_orderdate] +: s: o_orderdate .d \"{dd}/{mm}/{yyyy} {mmm} {ddd}\" #! o_orderdate",
        """SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y ') || upper(strftime(o_orderdate, '%b')) || ' ' || upper(strftime(o_orderdate, '%a')) AS s
           FROM orders""",
    ),
    "q_date_arith": (
        "orders # [o_orderkey o_orderdate] +: d: o_orderdate .d +: [due: d + 30 age: \"2000-01-01\" .d - d] #! o_orderdate",
        """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS DATE) + 30 AS due,
                  DATE '2000-01-01' - CAST(o_orderdate AS DATE) AS age FROM orders""",
    ),
    "q_ternary": (
        "part # [p_partkey p_size] +: kind: ?: p_size > 30 \"large\" (?: p_size > 10 \"middle\" \"small\")",
        """SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size,
                  CASE WHEN p_size > 30 THEN 'large' WHEN p_size > 10 THEN 'middle' ELSE 'small' END AS kind FROM part""",
    ),
    "q_split_pos": (
        "part # [p_partkey p_type] /> [word at]: p_type \"[ ]+\"",
        """SELECT p_partkey, unnest(string_split_regex(p_type, '[ ]+')) AS word,
                  CAST(generate_subscripts(string_split_regex(p_type, '[ ]+'), 1) AS BIGINT) AS at FROM part""",
    ),
    "q_split_set": (
        "part # p_type /> word: p_type \" \"",
        "SELECT DISTINCT unnest(string_split(p_type, ' ')) AS word FROM part",
    ),
    "q_cast": (
        """Money := type decimal(2)
part # [p_partkey p_retailprice p_size] +: [m: p_retailprice .as Money f: p_size .as float s: p_size .as str]""",
        """SELECT p_partkey, p_retailprice, CAST(p_size AS BIGINT) AS p_size, CAST(p_retailprice AS DECIMAL(38, 2)) AS m,
                  CAST(p_size AS DOUBLE) AS f, CAST(p_size AS VARCHAR) AS s FROM part""",
    ),
    "q_schema_apply": (
        "supplier # [s_suppkey s_nationkey s_acctbal] :: {attr type; \"s_nationkey\" \"str\"; \"s_acctbal\" \"decimal(1)\"}",
        """SELECT s_suppkey, CAST(s_nationkey AS VARCHAR) AS s_nationkey, CAST(s_acctbal AS DECIMAL(38, 1)) AS s_acctbal FROM supplier""",
    ),
    "q_schema_extract": (
        "region ::",
        "SELECT * FROM (VALUES ('r_name', 'str'), ('r_regionkey', 'int')) t(attr, type)",
    ),
    "q_in_constraint": (
        """Nation := type in(nation, n_nationkey)
supplier # [s_suppkey s_nationkey] :: {attr type; "s_nationkey" "Nation"}""",
        "SELECT s_suppkey, CAST(s_nationkey AS BIGINT) AS s_nationkey FROM supplier",
    ),
    "q_describe": (
        "nation ?. # [attr type inferred distinct pct empty]",
        """SELECT 'n_nationkey' AS attr, 'int' AS type, 'int' AS inferred, count(DISTINCT n_nationkey) AS distinct,
                  CAST(round_even(100.0 * count(DISTINCT n_nationkey) / count(*), 0) AS BIGINT) AS pct, CAST(0 AS BIGINT) AS empty FROM nation
           UNION ALL SELECT 'n_name', 'str', 'str', count(DISTINCT n_name),
                  CAST(round_even(100.0 * count(DISTINCT n_name) / count(*), 0) AS BIGINT), count(*) FILTER (n_name = '') FROM nation
           UNION ALL SELECT 'n_regionkey', 'int', 'int', count(DISTINCT n_regionkey),
                  CAST(round_even(100.0 * count(DISTINCT n_regionkey) / count(*), 0) AS BIGINT), CAST(0 AS BIGINT) FROM nation""",
    ),
    "q_iota_calendar": (
        "i. day: 366 +: d: \"1995-12-31\" .d + day ? d .d \"dow\" = 1 # [day d]",
        """SELECT range AS day, CAST(DATE '1995-12-31' + CAST(range AS INT) AS DATE) AS d FROM range(1, 367)
           WHERE isodow(DATE '1995-12-31' + CAST(range AS INT)) = 1""",
    ),
    "q_iota_zero": (
        "I. k: (nation /. [n: #.]) +: sq: k * k",
        "SELECT range AS k, range * range AS sq FROM range(0, (SELECT count(*) FROM nation))",
    ),
    "q_literal_join": (
        '{o_orderpriority weight; "1-URGENT" 5; "2-HIGH" 3; "5-LOW" 1} *. orders /. weight [n: #.]',
        """SELECT w AS weight, count(*) AS n FROM orders JOIN
           (VALUES ('1-URGENT', 5::BIGINT), ('2-HIGH', 3), ('5-LOW', 1)) v(p, w) ON p = o_orderpriority GROUP BY 1""",
    ),
    "q_function_compose": (
        """large := fn ? o_totalprice > 250000
byday := fn /. o_orderstatus [n: #.]
orders large byday""",
        "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 250000 GROUP BY 1",
    ),
    "q_assignment": (
        """big := customer ? c_acctbal > 9000
big *. (orders @ o_custkey c_custkey) /. c_custkey [n: #.]""",
        "SELECT c_custkey, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 9000 GROUP BY 1",
    ),
    "q_relation_aggregate": (
        "region # r_name +: [nations: #. nation top: >. nation.n_nationkey]",
        """SELECT r_name, (SELECT count(*) FROM nation) AS nations, CAST((SELECT max(n_nationkey) FROM nation) AS BIGINT) AS top FROM region""",
    ),
}


def session(spark: SparkSession, sf_dir: str, names: Iterable[str] = tuple(KEYS)) -> Session:
    """A session with these tables of the folder. Binding one lists its files and reads a footer."""
    out = Session(spark)
    for name in names:
        out.bind(name, spark.read.parquet(f"{sf_dir}/{name}.parquet"), KEYS[name], trusted=True)
    return out


def run(spark: SparkSession, sf_dir: str, statements: str) -> DataFrame:
    named = set(re.findall(r"\w+", statements))
    own = session(spark, sf_dir, [name for name in KEYS if name in named])
    last = None
    for line in statements.splitlines():
        last = own.run(line)
    return last.df if last.ordered else last.as_set().df


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and total value of orders in each market segment."""
    return run(spark, sf_dir, CATALOGUE["q_flagship"][0])


def read_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with quotes, commas and line breaks in its cells, written as CSV and read again."""
    folder = f"{shared_dir(spark)}/quillon-{spark.sparkContext.applicationId}/csv-{uuid.uuid4().hex}"
    own = session(spark, sf_dir, ["part"])
    written = own.run(CSV_ROWS)
    written = written._with(written.df.withColumn("note", F.replace("note", F.lit("/"), F.lit("\n"))))
    display.write_csv(written, folder)
    return tables.csv(spark, folder).as_set().df.withColumn("p_retailprice", F.col("p_retailprice").cast("double"))


#: The rows that read_csv writes; a line break stands for each slash.
CSV_ROWS = """part # [p_partkey p_name p_retailprice] +: note: "say \\"{p_name}\\", / {p_partkey} \\\\" .f #! p_name"""
CSV_SQL = """SELECT p_partkey, p_retailprice,
                    'say "' || p_name || '", ' || chr(10) || ' ' || p_partkey || ' ' || chr(92) AS note FROM part"""


def queries() -> dict:
    return {name: partial(run, statements=text) for name, (text, _) in CATALOGUE.items()} | {"q_csv": read_csv}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in CATALOGUE.items()} | {"q_csv": CSV_SQL}
