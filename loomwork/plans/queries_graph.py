"""Registered queries on the property graph that the relational tables make up.

Companies are regions, departments nations, teams (nation, market segment), employees customers, projects orders and
technologies parts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.functions.text import QUESTION_STOP_WORDS
from loomwork.operators import graph as G
from loomwork.plans.base import ORACLES, query, shared_dir, sql_round, states, table


def graph(spark, d) -> tuple[DataFrame, DataFrame]:
    """The stored graph; it is made when a query first asks for it, and anew when one of its tables changes."""
    return G.stored(spark, f"{shared_dir(spark)}/graph-{states(spark, d, *TABLES)}", lambda: made_graph(spark, d))


TABLES = ("region", "nation", "customer", "orders", "part", "lineitem")


def made_graph(spark, d) -> tuple[DataFrame, DataFrame]:
    t = lambda n: table(spark, d, n)
    r, n, c, o, p = t("region"), t("nation"), t("customer"), t("orders"), t("part")
    li = t("lineitem").select("l_orderkey", "l_partkey").distinct()
    id_ = lambda letter, key: F.concat(F.lit(letter), F.col(key).cast("string"))
    team_id = F.concat(F.lit("T"), F.col("c_nationkey").cast("string"), F.lit("-"), "c_mktsegment")
    bought = o.join(li, o.o_orderkey == li.l_orderkey).join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("o_custkey").agg(F.sort_array(F.collect_set("p_type")).alias("skills"))
    none = F.array().cast("array<string>")
    props = lambda *kv: F.create_map(*(x if not isinstance(x, str) else F.lit(x) for x in kv)).cast("map<string,string>")

    def nodes_of(df, key, label, name, skills=none, prop=None, more=()):
        return df.select(key.alias("id"), F.lit(label).alias("label"), name.alias("name"), F.array(name, *more).alias("fields"), skills.alias("skills"), (prop if prop is not None else F.create_map().cast("map<string,string>")).alias("props"))

    teams = c.select("c_nationkey", "c_mktsegment").distinct().join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    heads = n.join(c.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("h")), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    nodes = [
        nodes_of(r, id_("C", "r_regionkey"), "Company", F.col("r_name")),
        nodes_of(heads, id_("D", "n_nationkey"), "Department", F.col("n_name"), prop=props("headcount", F.coalesce("h", F.lit(0)).cast("string"))),
        nodes_of(teams, team_id, "Team", F.concat_ws(" ", "n_name", "c_mktsegment")),
        nodes_of(c.join(bought, F.col("c_custkey") == F.col("o_custkey"), "left"), id_("E", "c_custkey"), "Employee", F.col("c_name"), F.coalesce("skills", none), props("title", F.col("c_mktsegment"))),
        nodes_of(o, id_("P", "o_orderkey"), "Project", id_("Order#", "o_orderkey"), prop=props("status", F.col("o_orderstatus"))),
        nodes_of(p, id_("K", "p_partkey"), "Technology", F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")), prop=props("category", F.col("p_type"), "description", F.col("p_brand")), more=(F.col("p_brand"),)),
    ]
    null = lambda k: F.lit(None).cast(k)

    def edges_of(df, src, dst, rel, role=None, since=None, pct=None):
        return df.select(src.alias("src"), dst.alias("dst"), F.lit(rel).alias("rel"), (role if role is not None else null("string")).alias("role"), (since if since is not None else null("string")).alias("since"), (pct if pct is not None else null("int")).alias("allocation_pct"))

    pairs = n.alias("a").join(n.alias("b"), (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select(F.col("a.n_nationkey").alias("x"), F.col("b.n_nationkey").alias("y"))
    # employee 0 reports to employee 1, whose manager is 0: a cycle
    up = c.select("c_custkey", F.when(F.col("c_custkey") == 0, F.lit(1).cast("long")).otherwise(F.floor(F.col("c_custkey") / 10)).alias("m"))
    edges = [
        edges_of(n, id_("C", "n_regionkey"), id_("D", "n_nationkey"), "HAS_DEPARTMENT"),
        edges_of(teams, id_("D", "n_nationkey"), team_id, "HAS_TEAM"),
        edges_of(c, team_id, id_("E", "c_custkey"), "HAS_MEMBER"),
        edges_of(up, id_("E", "c_custkey"), id_("E", "m"), "REPORTS_TO"),
        edges_of(o, id_("E", "o_custkey"), id_("P", "o_orderkey"), "WORKS_ON", F.col("o_orderpriority"), F.to_date("o_orderdate").cast("string"), (F.col("o_orderkey") % 100).cast("int")),
        edges_of(li, id_("P", "l_orderkey"), id_("K", "l_partkey"), "USES_TECHNOLOGY"),
        edges_of(pairs, id_("D", "x"), id_("D", "y"), "COLLABORATES_WITH"),
        edges_of(o.join(c, F.col("o_custkey") == F.col("c_custkey")), id_("D", "c_nationkey"), id_("P", "o_orderkey"), "OWNS_PROJECT"),
    ]
    union = lambda xs: reduce(DataFrame.unionByName, xs)
    return union(nodes), union(edges)


LI = "li AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)"
MEMBERS = """mem AS (SELECT c_custkey, c_name, c_nationkey, c_mktsegment, n_name, n_name || ' ' || c_mktsegment AS team, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
SKILLS = f"{LI}, sk AS (SELECT DISTINCT o_custkey, p_type FROM orders JOIN li ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey)"
CHAIN = """up AS (SELECT c_custkey AS a, CASE WHEN c_custkey = 0 THEN 1 ELSE c_custkey // 10 END AS b FROM customer),
    ch AS (SELECT a, b, 1 AS depth FROM up UNION ALL SELECT x.a, y.b, 2 FROM up x JOIN up y ON x.b = y.a WHERE NOT (x.a = y.a AND x.b = y.b)
        UNION ALL SELECT x.a, z.b, 3 FROM up x JOIN up y ON x.b = y.a JOIN up z ON y.b = z.a WHERE NOT (x.a = y.a AND x.b = y.b) AND NOT (y.a = z.a AND y.b = z.b) AND NOT (x.a = z.a AND x.b = z.b)),
    chn AS (SELECT e.c_name AS employee, m.c_name AS manager, depth FROM ch JOIN customer e ON a = e.c_custkey JOIN customer m ON b = m.c_custkey)"""

KEYWORDS = ("nation_1", "HOUSEHOLD", "economy", "Customer#00000001", "ring 1", "zzz")
KW = "kw AS (SELECT unnest([" + ", ".join(f"'{k}'" for k in KEYWORDS) + "]) AS keyword)"


def kws(spark):
    return spark.createDataFrame([(k,) for k in KEYWORDS], "keyword string")


def sql_has(c: str, k: str = "keyword") -> str:
    return f"contains(lower({c}), lower({k}))"


@query("graph_lookup", "SELECT 'D' || n_nationkey AS id, n_name AS name FROM nation WHERE n_name = 'NATION_3' UNION ALL SELECT 'K' || p_partkey, p_name || ' ' || p_partkey FROM part WHERE p_type = 'ECONOMY'")
def graph_lookup(spark, d):
    n, _ = graph(spark, d)
    return G.lookup(n, "Department", "NATION_3").unionByName(G.lookup(n, "Technology", "ECONOMY", "category")).select("id", "name")


@query("graph_keyword", f"WITH {SKILLS} SELECT 'E' || c_custkey AS id, c_name AS name FROM customer WHERE {sql_has('c_name', chr(39) + '#00000001' + chr(39))} OR c_custkey IN (SELECT o_custkey FROM sk WHERE {sql_has('p_type', chr(39) + '#00000001' + chr(39))})")
def graph_keyword(spark, d):
    n, _ = graph(spark, d)
    return G.search(n, "Employee", "#00000001").select("id", "name")


@query("graph_keyword_batch", f"""WITH {KW}, {SKILLS}, nd AS (SELECT 'C' || r_regionkey AS id, 'Company' AS label, r_name AS f FROM region UNION ALL SELECT 'D' || n_nationkey, 'Department', n_name FROM nation
    UNION ALL SELECT DISTINCT 'T' || c_nationkey || '-' || c_mktsegment, 'Team', n_name || ' ' || c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'E' || c_custkey, 'Employee', c_name FROM customer
    UNION ALL SELECT 'E' || o_custkey, 'Employee', p_type FROM sk UNION ALL SELECT 'P' || o_orderkey, 'Project', 'Order#' || o_orderkey FROM orders UNION ALL SELECT 'K' || p_partkey, 'Technology', p_name || ' ' || p_partkey FROM part UNION ALL SELECT 'K' || p_partkey, 'Technology', p_brand FROM part)
    SELECT DISTINCT id, label FROM nd JOIN kw ON {sql_has('f')}""")  # fmt: skip
def graph_keyword_batch(spark, d):
    n, _ = graph(spark, d)
    return G.search_many(n, kws(spark)).select("id", "label")


@query("graph_hierarchy", f"WITH {MEMBERS} SELECT r_name AS company, coalesce(string_agg(DISTINCT n_name, ',' ORDER BY n_name), '') AS departments, coalesce(string_agg(DISTINCT team, ',' ORDER BY team), '') AS teams, coalesce(string_agg(DISTINCT c_name, ',' ORDER BY c_name), '') AS employees FROM (SELECT r_name, n_name, team, c_name FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN mem USING (r_name, n_name)) GROUP BY r_name")
def graph_hierarchy(spark, d):
    h = G.hierarchy(*graph(spark, d))
    return h.select("company", *(F.array_join(c, ",").alias(c) for c in ("departments", "teams", "employees")))


@query("graph_employee_context", f"""WITH {MEMBERS}, {LI}, up AS (SELECT c_custkey AS a, CASE WHEN c_custkey = 0 THEN 1 ELSE c_custkey // 10 END AS b FROM customer)
    SELECT m.c_name AS employee, g.c_name AS manager, team, n_name AS department, (SELECT string_agg(DISTINCT 'Order#' || o_orderkey, ',' ORDER BY 'Order#' || o_orderkey) FROM orders WHERE o_custkey = m.c_custkey) AS projects,
        (SELECT count(DISTINCT l_partkey) FROM orders JOIN li ON o_orderkey = l_orderkey WHERE o_custkey = m.c_custkey) AS n_technologies
    FROM mem m JOIN up ON a = m.c_custkey LEFT JOIN customer g ON b = g.c_custkey""")  # fmt: skip
def graph_employee_context(spark, d):
    e = G.employee_context(*graph(spark, d))
    return e.select("employee", "manager", "team", "department", F.array_join("projects", ",").alias("projects"), F.coalesce(F.size("technologies"), F.lit(0)).alias("n_technologies")).withColumn("n_technologies", F.greatest("n_technologies", F.lit(0)))


@query("graph_one_hop", f"""WITH {LI} SELECT 'collaborators' AS hop, n.n_name AS name FROM nation n JOIN nation m ON m.n_name = 'NATION_1' AND n.n_regionkey = m.n_regionkey AND n.n_nationkey > m.n_nationkey
    UNION ALL SELECT 'owner', n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderkey = 7
    UNION ALL SELECT 'projects', 'Order#' || l_orderkey FROM li JOIN part ON l_partkey = p_partkey WHERE p_name || ' ' || p_partkey = 'red widget 1'""")  # fmt: skip
def graph_one_hop(spark, d):
    n, e = graph(spark, d)
    hop = lambda name, df: df.select(F.lit(name).alias("hop"), "name")
    return (
        hop("collaborators", G.neighbours(n, e, "COLLABORATES_WITH", "Department", "NATION_1"))
        .unionByName(hop("owner", G.neighbours(n, e, "OWNS_PROJECT", "Project", "Order#7", out=False)))
        .unionByName(hop("projects", G.neighbours(n, e, "USES_TECHNOLOGY", "Technology", "red widget 1", out=False)))
    )


@query("graph_paged", "WITH m AS (SELECT c_custkey, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA') SELECT 'E' || c_custkey AS id, c_name AS name FROM m ORDER BY c_name, id LIMIT 100 OFFSET 20")
def graph_paged(spark, d):
    return G.page(G.company_employees(*graph(spark, d), "ASIA").select("id", "name"), 20, 500, "name", "id")


@query("graph_hier_path", f"""WITH {KW}, {MEMBERS}, {SKILLS}, h AS (SELECT keyword, r_name, n_name, team, c_name FROM mem JOIN kw ON {sql_has('n_name')} OR {sql_has('team')} OR {sql_has('c_name')} OR EXISTS (SELECT 1 FROM sk WHERE o_custkey = c_custkey AND {sql_has('p_type')}))
    SELECT keyword, row_number() OVER (PARTITION BY keyword ORDER BY r_name, n_name, team, c_name) AS n, r_name || ' → ' || n_name || ' → ' || team || ' → ' || c_name AS line FROM h QUALIFY n <= 10""")  # fmt: skip
def graph_hier_path(spark, d):
    return G.hierarchy_paths(*graph(spark, d), kws(spark))


@query("graph_project_path", f"""WITH {KW}, {LI}, h AS (SELECT keyword, c_name, o_orderpriority, 'Order#' || o_orderkey AS project, p_name || ' ' || p_partkey AS tech FROM customer JOIN orders ON o_custkey = c_custkey JOIN li ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
        JOIN kw ON {sql_has('c_name')} OR {sql_has("'Order#' || o_orderkey")} OR {sql_has("p_name || ' ' || p_partkey")}), g AS (SELECT keyword, c_name, o_orderpriority, project, string_agg(DISTINCT tech, ', ' ORDER BY tech) AS ts FROM h GROUP BY ALL)
    SELECT keyword, row_number() OVER (PARTITION BY keyword ORDER BY c_name, project, o_orderpriority) AS n, c_name || ' works on ' || project || ' as ' || o_orderpriority || ' using ' || ts AS line FROM g QUALIFY n <= 10""")  # fmt: skip
def graph_project_path(spark, d):
    return G.project_paths(*graph(spark, d), kws(spark))


@query("graph_mgmt_chain", f"""WITH {KW}, {CHAIN} SELECT keyword, row_number() OVER (PARTITION BY keyword ORDER BY depth, employee, manager) AS n, employee || ' reports to ' || manager || ' (chain depth ' || depth || ')' AS line
    FROM chn JOIN kw ON {sql_has('employee')} OR {sql_has('manager')} QUALIFY n <= 10""")  # fmt: skip
def graph_mgmt_chain(spark, d):
    return G.management_chain(*graph(spark, d), kws(spark))


@query("graph_mgmt_pairs", f"WITH {CHAIN} SELECT 'E' || a AS employee, 'E' || b AS manager, depth::BIGINT AS depth FROM ch")
def graph_mgmt_pairs(spark, d):
    return G.management_pairs(graph(spark, d)[1]).select(F.col("a").alias("employee"), F.col("b").alias("manager"), "depth")


@query("graph_collab", f"""WITH {KW}, p AS (SELECT a.n_name AS l, b.n_name AS r FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey)
    SELECT keyword, row_number() OVER (PARTITION BY keyword ORDER BY l, r) AS n, 'Department ' || l || ' collaborates with ' || r AS line FROM p JOIN kw ON {sql_has('l')} OR {sql_has('r')} QUALIFY n <= 10""")  # fmt: skip
def graph_collab(spark, d):
    return G.collaborations(*graph(spark, d), kws(spark))


QUESTIONS = ((1, "Who in Household works on widgets?"), (2, "Which ring has Brand#12?"), (3, "What is the zzz?"))
SQL_QS = "qs AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in QUESTIONS) + ") t(qid, question))"
SQL_KWS = rf"""kq AS (SELECT qid, w AS keyword FROM (SELECT qid, unnest(regexp_split_to_array(regexp_replace(lower(question), '[^a-z0-9 ]', ' ', 'g'), '\s+')) AS w FROM qs) WHERE length(w) > 2 AND w NOT IN ({", ".join(f"'{w}'" for w in QUESTION_STOP_WORDS)}) GROUP BY ALL)"""


def asked(spark):
    return spark.createDataFrame(QUESTIONS, "qid int, question string")


def words(spark, d, nodes):
    """The graph's full-text index, kept in the shared folder as long as its tables stay as they are."""
    return G.stored_index(spark, f"{shared_dir(spark)}/graph-words-{states(spark, d, *TABLES)}", nodes)


SQL_WORDS = """nd AS (SELECT 'C' || r_regionkey AS id, 'Company' AS label, r_name AS name, r_name AS f FROM region UNION ALL SELECT 'D' || n_nationkey, 'Department', n_name, n_name FROM nation
    UNION ALL SELECT DISTINCT 'T' || c_nationkey || '-' || c_mktsegment, 'Team', n_name || ' ' || c_mktsegment, n_name || ' ' || c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'E' || c_custkey, 'Employee', c_name, c_name FROM customer
    UNION ALL SELECT 'P' || o_orderkey, 'Project', 'Order#' || o_orderkey, 'Order#' || o_orderkey FROM orders UNION ALL SELECT 'K' || p_partkey, 'Technology', p_name || ' ' || p_partkey, p_name || ' ' || p_partkey || ' ' || p_brand FROM part),
    wd AS (SELECT DISTINCT id, name, label, unnest(regexp_split_to_array(lower(f), '[^a-z0-9]+')) AS word FROM nd)"""


@query("graph_index", f"WITH {SQL_WORDS} SELECT word, id, name, label FROM wd WHERE word <> ''")
def graph_index(spark, d):
    n, _ = graph(spark, d)
    return words(spark, d, n)


@query("graph_seed", """SELECT * FROM (VALUES ('Company', 1), ('Department', 3), ('Team', 6), ('Employee', 10), ('Project', 5), ('Technology', 12), ('HAS_DEPARTMENT', 3), ('HAS_TEAM', 6), ('HAS_MEMBER', 11), ('REPORTS_TO', 8),
    ('OWNS_PROJECT', 5), ('WORKS_ON', 19), ('COLLABORATES_WITH', 5), ('USES_TECHNOLOGY', 17)) t(kind, n)""")  # fmt: skip
def graph_seed(spark, d):
    """Nodes and edges of the seeded company by kind, saved twice: a save of what is known changes nothing."""
    once = G.save(None, *G.seed(spark))
    n, e = G.save(once, *G.seed(spark))
    counted = lambda df, c: df.groupBy(F.col(c).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return counted(n, "label").unionByName(counted(e, "rel"))


@query("graph_fulltext", f"""WITH {SQL_QS}, {SQL_KWS}, nd AS (SELECT 'C' || r_regionkey AS id, 'Company' AS label, r_name AS name, r_name AS f FROM region UNION ALL SELECT 'D' || n_nationkey, 'Department', n_name, n_name FROM nation
    UNION ALL SELECT DISTINCT 'T' || c_nationkey || '-' || c_mktsegment, 'Team', n_name || ' ' || c_mktsegment, n_name || ' ' || c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'E' || c_custkey, 'Employee', c_name, c_name FROM customer
    UNION ALL SELECT 'P' || o_orderkey, 'Project', 'Order#' || o_orderkey, 'Order#' || o_orderkey FROM orders UNION ALL SELECT 'K' || p_partkey, 'Technology', p_name || ' ' || p_partkey, p_name || ' ' || p_partkey || ' ' || p_brand FROM part),
    wd AS (SELECT DISTINCT id, name, label, unnest(regexp_split_to_array(lower(f), '[^a-z0-9]+')) AS word FROM nd), ht AS (SELECT DISTINCT qid, keyword, id, name, label FROM wd JOIN kq ON starts_with(word, keyword)),
    df AS (SELECT qid, keyword, count(*) AS df FROM ht GROUP BY ALL), sc AS (SELECT qid, id, name, label, {sql_round("sum(ln(((SELECT count(*) FROM nd) - df + 0.5) / (df + 0.5) + 1))")} AS score FROM ht JOIN df USING (qid, keyword) GROUP BY ALL)
    SELECT qid::BIGINT AS qid, id, name, label, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, name, id) AS n FROM sc QUALIFY n <= 30""")  # fmt: skip
def graph_fulltext(spark, d):
    n, _ = graph(spark, d)
    return G.full_text(n, G.question_keywords(asked(spark)), index=words(spark, d, n))


SQL_NUMBERED = rf"""kn AS (SELECT qid, w AS keyword, row_number() OVER (PARTITION BY qid ORDER BY i) - 1 AS kw_no FROM (SELECT qid, w, min(i) AS i FROM (SELECT qid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM
    (SELECT qid, regexp_split_to_array(regexp_replace(lower(question), '[^a-z0-9 ]', ' ', 'g'), '\s+') AS ws FROM qs)) WHERE length(w) > 2 AND w NOT IN ({", ".join(f"'{w}'" for w in QUESTION_STOP_WORDS)}) GROUP BY ALL) QUALIFY kw_no < 8)"""


def sql_lines(of: str) -> str:
    """A path query's lines for the questions' keywords."""
    return "(" + ORACLES[of].replace(KW, "kw AS (SELECT DISTINCT keyword FROM kn)") + ")"


def sql_listed(what: str, tables: str, where: str, sep: str = ", ") -> str:
    return f"(SELECT string_agg(x, '{sep}' ORDER BY x) FROM (SELECT DISTINCT {what} AS x FROM {tables} WHERE {where}))"


SQL_CONTEXT = f"""WITH {SQL_QS}, {SQL_NUMBERED}, {SQL_KWS}, {SQL_WORDS}, {SKILLS}, mng AS (SELECT c_custkey AS a, CASE WHEN c_custkey = 0 THEN 1 ELSE c_custkey // 10 END AS b FROM customer),
    ht AS (SELECT DISTINCT qid, keyword, id, name, label FROM wd JOIN kq ON starts_with(word, keyword)), df AS (SELECT qid, keyword, count(*) AS df FROM ht GROUP BY ALL),
    sc AS (SELECT qid, id, name, label, {sql_round("sum(ln(((SELECT count(*) FROM nd) - df + 0.5) / (df + 0.5) + 1))")} AS score FROM ht JOIN df USING (qid, keyword) GROUP BY ALL),
    ft AS (SELECT qid, name, label, row_number() OVER (PARTITION BY qid ORDER BY score DESC, name, id) AS n FROM sc QUALIFY n <= 30),
    em AS (SELECT DISTINCT qid, c_custkey AS k, c_name, c_mktsegment FROM customer JOIN kn ON {sql_has('c_name')} OR c_custkey IN (SELECT o_custkey FROM sk WHERE {sql_has('p_type')})),
    dp AS (SELECT DISTINCT qid, n_nationkey AS k, n_regionkey, n_name FROM nation JOIN kn ON {sql_has('n_name')}),
    pj AS (SELECT DISTINCT qid, o_orderkey AS k, o_orderstatus FROM orders JOIN kn ON {sql_has("'Order#' || o_orderkey")}),
    te AS (SELECT DISTINCT qid, p_partkey AS k, p_name, p_type, p_brand FROM part JOIN kn ON {sql_has("p_name || ' ' || p_partkey")} OR {sql_has('p_brand')}),
    st AS (SELECT 6 AS no, * FROM {sql_lines('graph_hier_path')} UNION ALL SELECT 7, * FROM {sql_lines('graph_project_path')} UNION ALL SELECT 8, * FROM {sql_lines('graph_mgmt_chain')} UNION ALL SELECT 9, * FROM {sql_lines('graph_collab')}),
    ln_ AS (SELECT qid, 1 AS stage, printf('%08d', n) AS ord, 'Found entity: ' || name || ' [' || label || ' ]' AS line FROM ft
        UNION ALL SELECT qid, 2, 'E' || k, 'Employee ' || c_name || ' (' || c_mktsegment || ')' || coalesce(' reports to ' || {sql_listed('c_name', 'mng JOIN customer ON b = c_custkey', 'a = k')}, '') || coalesce('. Skills: ' || {sql_listed('p_type', 'sk', 'o_custkey = k')}, '')
            || coalesce('. ' || {sql_listed("'Works on Order#' || o_orderkey || ' as ' || o_orderpriority || ' (' || o_orderkey % 100 || '% allocation)'", 'orders', 'o_custkey = k', '. ')}, '') FROM em
        UNION ALL SELECT qid, 3, 'D' || k, 'Department ' || n_name || ' (' || (SELECT count(*) FROM customer WHERE c_nationkey = k) || ' headcount)' || coalesce('. Teams: ' || {sql_listed("dp.n_name || ' ' || c_mktsegment", 'customer', 'c_nationkey = k')}, '')
            || coalesce('. Collaborates with: ' || {sql_listed('o.n_name', 'nation o', 'o.n_regionkey = dp.n_regionkey AND o.n_nationkey > k')}, '') || coalesce('. Owns projects: ' || {sql_listed("'Order#' || o_orderkey", 'orders JOIN customer ON o_custkey = c_custkey', 'c_nationkey = k')}, '') FROM dp
        UNION ALL SELECT qid, 4, 'P' || k, 'Project Order#' || k || ' (status: ' || o_orderstatus || ')' || coalesce('. Uses technologies: ' || {sql_listed("p_name || ' ' || p_partkey", 'li JOIN part ON l_partkey = p_partkey', 'l_orderkey = k')}, '') FROM pj
        UNION ALL SELECT qid, 5, 'K' || k, 'Technology ' || p_name || ' ' || k || ' (' || p_type || '): ' || p_brand FROM te
        UNION ALL SELECT qid, 6, printf('%08d %02d %08d', kw_no, no, n), line FROM st JOIN kn USING (keyword)),
    un AS (SELECT qid, line, min({{'stage': stage, 'ord': ord}}) AS place FROM ln_ GROUP BY qid, line), nn AS (SELECT qid, line, row_number() OVER (PARTITION BY qid ORDER BY place, line) AS n FROM un QUALIFY n <= 60)
    SELECT qid::BIGINT AS qid, CASE WHEN count(line) = 0 THEN '{G.NOTHING}' ELSE '{G.HEADER}' || chr(10) || string_agg('• ' || line, chr(10) ORDER BY n) || chr(10) || '{G.FOOTER}' END AS context, count(line)::BIGINT AS n_lines FROM qs LEFT JOIN nn USING (qid) GROUP BY qid"""


@query("graph_context", SQL_CONTEXT)
def graph_context(spark, d):
    n, e = graph(spark, d)
    return G.context(n, e, asked(spark), index=words(spark, d, n))


@query("graph_answer", f"SELECT qid, FALSE AS blocked, n_lines FROM ({SQL_CONTEXT})")
def graph_answer(spark, d):
    from loomwork.plans.pipeline import graph_answer as answer

    return answer(asked(spark), *graph(spark, d)).select("qid", "blocked", "n_lines")


@query("graph_stats", f"""WITH {LI}, c AS (SELECT 'Company' AS label, count(*) AS n FROM region UNION ALL SELECT 'Department', count(*) FROM nation UNION ALL SELECT 'Team', count(DISTINCT (c_nationkey, c_mktsegment)) FROM customer
    UNION ALL SELECT 'Employee', count(*) FROM customer UNION ALL SELECT 'Project', count(*) FROM orders UNION ALL SELECT 'Technology', count(*) FROM part)
    SELECT label, n::BIGINT AS n FROM c UNION ALL SELECT 'nodes', sum(n)::BIGINT FROM c UNION ALL SELECT 'relationships', ((SELECT count(*) FROM nation) + (SELECT count(DISTINCT (c_nationkey, c_mktsegment)) FROM customer) + 2 * (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders)
        + (SELECT count(*) FROM li) + (SELECT count(*) FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey) + (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey))::BIGINT""")  # fmt: skip
def graph_stats(spark, d):
    return G.stats(*graph(spark, d))


SQL_NODES = """SELECT 'C' || r_regionkey AS id, 'Company' AS label, r_name AS name FROM region UNION ALL SELECT 'D' || n_nationkey, 'Department', n_name FROM nation
    UNION ALL SELECT DISTINCT 'T' || c_nationkey || '-' || c_mktsegment, 'Team', n_name || ' ' || c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT 'E' || c_custkey, 'Employee', c_name FROM customer UNION ALL SELECT 'P' || o_orderkey, 'Project', 'Order#' || o_orderkey FROM orders
    UNION ALL SELECT 'K' || p_partkey, 'Technology', p_name || ' ' || p_partkey FROM part"""
SQL_LINKS = f"""WITH {LI} SELECT 'D' || a.n_nationkey AS source, 'D' || b.n_nationkey AS target, 'COLLABORATES_WITH' AS type FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey
    UNION ALL SELECT 'C' || n_regionkey, 'D' || n_nationkey, 'HAS_DEPARTMENT' FROM nation UNION ALL SELECT 'T' || c_nationkey || '-' || c_mktsegment, 'E' || c_custkey, 'HAS_MEMBER' FROM customer
    UNION ALL SELECT DISTINCT 'D' || c_nationkey, 'T' || c_nationkey || '-' || c_mktsegment, 'HAS_TEAM' FROM customer UNION ALL SELECT 'D' || c_nationkey, 'P' || o_orderkey, 'OWNS_PROJECT' FROM orders JOIN customer ON o_custkey = c_custkey
    UNION ALL SELECT 'E' || c_custkey, 'E' || CASE WHEN c_custkey = 0 THEN 1 ELSE c_custkey // 10 END, 'REPORTS_TO' FROM customer UNION ALL SELECT 'P' || l_orderkey, 'K' || l_partkey, 'USES_TECHNOLOGY' FROM li
    UNION ALL SELECT 'E' || o_custkey, 'P' || o_orderkey, 'WORKS_ON' FROM orders"""


@query("graph_export_nodes", f"SELECT id, label, name FROM ({SQL_NODES}) ORDER BY label, id LIMIT 2000")
def graph_export_nodes(spark, d):
    return G.export(*graph(spark, d))[0]


@query("graph_export_links", f"SELECT source, target, type FROM ({SQL_LINKS}) ORDER BY type, source, target LIMIT 10000")
def graph_export_links(spark, d):
    return G.export(*graph(spark, d))[1]
