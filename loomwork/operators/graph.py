"""A property graph as tables, and its lookups, paths and contexts.

nodes: id (string, label and key), label, name, and the text fields name, description, bio, focus, goal, purpose as
`fields` (array<string>), skills (array<string>), props (map). edges: src, dst, rel, and role, since, allocation_pct.
Every limited result has a total order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.functions.text import keywords
from loomwork.functions.vectors import score as rounded
from loomwork.operators.lexical import idf
from loomwork.sources.tables import MOST_ALONE, built_once, join_small, tree

PATH_LIMIT = 10
FULLTEXT_LIMIT = 30
CONTEXT_NODES = 20
HEADER, FOOTER, NOTHING = "=== Graph Knowledge Context ===", "=== End of Context ===", "No relevant graph context found."


def has(c: Column, kw: Column) -> Column:
    """kw is contained in c, whatever the case; null is no match."""
    return F.coalesce(F.contains(F.lower(c), F.lower(kw)), F.lit(False))


def mentions(fields: Column, kw: Column) -> Column:
    return F.coalesce(F.exists(fields, lambda x: has(x, kw)), F.lit(False))


def lookup(nodes: DataFrame, label: str, value, prop: str = "name") -> DataFrame:
    c = F.col("name") if prop == "name" else F.col("props")[prop]
    return nodes.filter((F.col("label") == label) & (c == value))


def search(nodes: DataFrame, label: str, kw: str) -> DataFrame:
    """Nodes of a label with the keyword in a text field or a skill."""
    k = F.lit(kw)
    return nodes.filter((F.col("label") == label) & (mentions(F.col("fields"), k) | mentions(F.col("skills"), k)))


def search_many(nodes: DataFrame, kws: DataFrame, kw: str = "keyword") -> DataFrame:
    """Nodes that any keyword hits, each once. Keywords come from questions and are few; nodes stay where they are."""
    found = kws.select(F.col(kw).alias("_kw")).distinct()
    return join_small(nodes, found, mentions(F.col("fields"), F.col("_kw")) | mentions(F.col("skills"), F.col("_kw")), "left_semi")


def ends(edges: DataFrame, rel: str, a: str, b: str, *more: str) -> DataFrame:
    return edges.filter(F.col("rel") == rel).select(F.col("src").alias(a), F.col("dst").alias(b), *more)


def names(nodes: DataFrame, label: str, key: str, name: str, *more: str) -> DataFrame:
    return nodes.filter(F.col("label") == label).select(F.col("id").alias(key), F.col("name").alias(name), *more)


def hierarchy(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """company, n_departments, departments, teams, employees of each company: sorted distinct names, a level may be empty."""
    c = names(nodes, "Company", "c", "company")
    d = ends(edges, "HAS_DEPARTMENT", "c", "d").join(names(nodes, "Department", "d", "department"), "d")
    t = ends(edges, "HAS_TEAM", "d", "t").join(names(nodes, "Team", "t", "team"), "t")
    e = ends(edges, "HAS_MEMBER", "t", "e").join(names(nodes, "Employee", "e", "employee"), "e")
    # each level is reduced on its own, so that no level multiplies the rows of another
    of_d = c.join(d, "c").groupBy("c").agg(F.collect_set("department").alias("departments"))
    of_t = d.join(t, "d").groupBy("c").agg(F.collect_set("team").alias("teams"))
    of_e = d.join(t, "d").join(e, "t").groupBy("c").agg(F.collect_set("employee").alias("employees"))
    out = c.join(of_d, "c", "left").join(of_t, "c", "left").join(of_e, "c", "left")
    return out.select("company", *(F.sort_array(F.coalesce(x, F.array().cast("array<string>"))).alias(x) for x in ("departments", "teams", "employees")))


def employee_context(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """employee, manager, team, department, projects, technologies of every employee."""
    e = names(nodes, "Employee", "e", "employee")
    m = ends(edges, "REPORTS_TO", "e", "m").join(names(nodes, "Employee", "m", "manager"), "m").groupBy("e").agg(F.min("manager").alias("manager"))
    t = ends(edges, "HAS_MEMBER", "t", "e").join(names(nodes, "Team", "t", "team"), "t")
    d = ends(edges, "HAS_TEAM", "d", "t").join(names(nodes, "Department", "d", "department"), "d").select("t", "department")
    where = t.join(d, "t", "left").groupBy("e").agg(F.min("team").alias("team"), F.min("department").alias("department"))
    w = ends(edges, "WORKS_ON", "e", "p").join(names(nodes, "Project", "p", "project"), "p")
    work = w.groupBy("e").agg(F.sort_array(F.collect_set("project")).alias("projects"))
    u = ends(edges, "USES_TECHNOLOGY", "p", "k").join(names(nodes, "Technology", "k", "technology"), "k")
    tech = w.join(u, "p").groupBy("e").agg(F.sort_array(F.collect_set("technology")).alias("technologies"))
    return e.join(m, "e", "left").join(where, "e", "left").join(work, "e", "left").join(tech, "e", "left")


def neighbours(nodes: DataFrame, edges: DataFrame, rel: str, label: str, name: str, out: bool = True) -> DataFrame:
    """Nodes one hop from the named node, along or against the edges, as a bag."""
    a, b = ("src", "dst") if out else ("dst", "src")
    start = nodes.filter((F.col("label") == label) & (F.col("name") == name)).select(F.col("id").alias(a))
    hops = edges.filter(F.col("rel") == rel).join(start, a, "left_semi").select(F.col(b).alias("id"))
    return hops.join(nodes, "id")


def page(df: DataFrame, offset: int, limit: int, *order: str, cap: int = 100) -> DataFrame:
    """A page in a total order; the limit is capped."""
    return df.orderBy(*order).offset(offset).limit(min(limit, cap))


def company_employees(nodes: DataFrame, edges: DataFrame, company: str) -> DataFrame:
    """Employees three hops below a company; one in two teams comes twice."""
    c = names(nodes, "Company", "c", "company").filter(F.col("company") == company)
    path = c.join(ends(edges, "HAS_DEPARTMENT", "c", "d"), "c").join(ends(edges, "HAS_TEAM", "d", "t"), "d").join(ends(edges, "HAS_MEMBER", "t", "id"), "t")
    return path.select("id", "t").join(nodes.filter(F.col("label") == "Employee"), "id")


# --- paths; keywords as a table (qid, keyword), each path limited per keyword


def limited(df: DataFrame, order: list, limit: int = PATH_LIMIT) -> DataFrame:
    w = Window.partitionBy("keyword").orderBy(*order)
    return df.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= limit)


def hits(nodes: DataFrame, label: str, as_id: str, kws: DataFrame, skills: bool = False, rows: int | None = None) -> DataFrame:
    """keyword, as_id: nodes of a label whose name (or a skill) has a keyword. Keywords are compared with nodes, never with paths."""
    k = F.col("keyword")
    found = has(F.col("name"), k) | mentions(F.col("skills"), k) if skills else has(F.col("name"), k)
    return join_small(nodes.filter(F.col("label") == label), kws, found, rows=rows).select("keyword", F.col("id").alias(as_id)).distinct()


def hierarchy_paths(nodes: DataFrame, edges: DataFrame, kws: DataFrame, rows: int | None = None) -> DataFrame:
    """keyword, n, line: company to employee, where a name below the company or a skill has the keyword."""
    dt, te = ends(edges, "HAS_TEAM", "d", "t"), ends(edges, "HAS_MEMBER", "t", "e")
    # from the nodes that are hit to the members below or the teams above, then up to the company
    below = hits(nodes, "Department", "d", kws, rows=rows).join(dt, "d").join(te, "t").select("keyword", "d", "t", "e")
    teams = hits(nodes, "Team", "t", kws, rows=rows).join(te, "t").join(dt, "t").select("keyword", "d", "t", "e")
    own = hits(nodes, "Employee", "e", kws, skills=True, rows=rows).join(te, "e").join(dt, "t").select("keyword", "d", "t", "e")
    some = below.unionByName(teams).unionByName(own).distinct()
    up = some.join(ends(edges, "HAS_DEPARTMENT", "c", "d"), "d").join(names(nodes, "Company", "c", "company"), "c")
    named = up.join(names(nodes, "Department", "d", "department"), "d").join(names(nodes, "Team", "t", "team"), "t").join(names(nodes, "Employee", "e", "employee"), "e")
    found = limited(named, ["company", "department", "team", "employee"])
    return found.select("keyword", "n", F.concat_ws(" → ", "company", "department", "team", "employee").alias("line"))


def project_paths(nodes: DataFrame, edges: DataFrame, kws: DataFrame, rows: int | None = None) -> DataFrame:
    """keyword, n, line: who works on what as which role using which technologies.

    A keyword on a technology keeps only such technologies, one on the employee or project keeps all.
    """
    w, u = ends(edges, "WORKS_ON", "e", "p", "role"), ends(edges, "USES_TECHNOLOGY", "p", "k")
    columns = ("keyword", "e", "p", "role", "k")
    whole = hits(nodes, "Employee", "e", kws, rows=rows).join(w, "e").select("keyword", "e", "p", "role").unionByName(hits(nodes, "Project", "p", kws, rows=rows).join(w, "p").select("keyword", "e", "p", "role")).distinct()
    part = hits(nodes, "Technology", "k", kws, rows=rows).join(u, "k").join(w, "p").select(*columns)
    some = whole.join(u, "p").select(*columns).unionByName(part).distinct()
    named = some.join(names(nodes, "Employee", "e", "employee"), "e").join(names(nodes, "Project", "p", "project"), "p").join(names(nodes, "Technology", "k", "technology"), "k")
    grouped = named.groupBy("keyword", "employee", "role", "project").agg(F.sort_array(F.collect_set("technology")).alias("technologies"))
    found = limited(grouped, ["employee", "project", "role"])
    return found.select("keyword", "n", F.format_string("%s works on %s as %s using %s", "employee", "project", "role", F.array_join("technologies", ", ")).alias("line"))


def trails(edges: DataFrame, hops: int, seeds: DataFrame | None = None, up: bool = True) -> DataFrame:
    """a, b, depth, steps (and seeds' columns): trails of 1 to `hops` REPORTS_TO edges; none uses an edge twice, so cycles end.

    seeds (id and more) are where trails start (up) or end; without them all trails are listed.
    """
    e = edges.filter(F.col("rel") == "REPORTS_TO").select(F.col("src").alias("a"), F.col("dst").alias("b")).withColumn("step", F.concat_ws("→", "a", "b"))
    end, other = ("b", "a") if up else ("a", "b")
    first = e if seeds is None else e.join(seeds.withColumnRenamed("id", other), other)
    trail = first.withColumn("steps", F.array("step")).drop("step").withColumn("depth", F.lit(1))
    out = trail
    for depth in range(2, hops + 1):
        nxt = e.select(F.col(other).alias(end), F.col(end).alias("_next"), "step")
        longer = trail.join(nxt, end).filter(~F.array_contains("steps", F.col("step"))).drop(end).withColumnRenamed("_next", end)
        one = F.array("step")
        trail = longer.withColumn("steps", F.concat("steps", one) if up else F.concat(one, "steps")).drop("step").withColumn("depth", F.lit(depth))
        out = out.unionByName(trail)
    return out


def management_pairs(edges: DataFrame, hops: int = 3) -> DataFrame:
    """employee id, manager id, depth of all trails."""
    return trails(edges, hops).select("a", "b", "depth")


def management_chain(nodes: DataFrame, edges: DataFrame, kws: DataFrame, rows: int | None = None, hops: int = 3) -> DataFrame:
    """keyword, n, line of trails whose first or last employee has the keyword: they are followed from the nodes that are hit."""
    seeds = hits(nodes, "Employee", "id", kws, rows=rows)
    both = trails(edges, hops, seeds, True).unionByName(trails(edges, hops, seeds, False))
    once = both.dropDuplicates(["keyword", "steps"])
    named = once.join(names(nodes, "Employee", "a", "employee"), "a").join(names(nodes, "Employee", "b", "manager"), "b")
    found = limited(named, ["depth", "employee", "manager"])
    return found.select("keyword", "n", F.format_string("%s reports to %s (chain depth %s)", "employee", "manager", F.col("depth").cast("string")).alias("line"))


def collaborations(nodes: DataFrame, edges: DataFrame, kws: DataFrame, rows: int | None = None) -> DataFrame:
    a, b = names(nodes, "Department", "a", "left"), names(nodes, "Department", "b", "right")
    k = F.col("keyword")
    named = join_small(ends(edges, "COLLABORATES_WITH", "a", "b").join(a, "a").join(b, "b"), kws, has(F.col("left"), k) | has(F.col("right"), k), rows=rows)
    return limited(named, ["left", "right"]).select("keyword", "n", F.format_string("Department %s collaborates with %s", "left", "right").alias("line"))


STRATEGIES = (hierarchy_paths, project_paths, management_chain, collaborations)


# --- full text and context


def word_index(nodes: DataFrame) -> DataFrame:
    """word, id, name, label: the distinct words of the nodes' text fields."""
    words = F.array_distinct(F.flatten(F.transform("fields", lambda x: F.split(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+"))))
    return nodes.select(F.explode(words).alias("word"), "id", "name", "label").filter(F.col("word") != "")


def stored_index(spark: SparkSession, path: str, nodes: DataFrame) -> DataFrame:
    """word_index() kept at path, sorted by word, which the first call builds; a search reads the pages of its keywords' ranges."""
    return built_once(spark, path, lambda: word_index(nodes).repartitionByRange("word", "id").sortWithinPartitions("word", "id"))


def ranges_of(keywords: list[str]) -> Column:
    """word begins with one of the keywords, as ranges that a scan can prune by: [keyword, what comes after all that begin with it)."""
    return tree([(F.col("word") >= k) & (F.col("word") < k[:-1] + chr(ord(k[-1]) + 1)) for k in sorted(keywords)]) if keywords else F.lit(False)


def by_prefix(words: DataFrame, each: DataFrame, rows: int | None = None) -> DataFrame:
    """words with kw, one row for each of the distinct keywords `each` (kw) that the word begins with.

    A word is cut to the lengths that keywords have, of which there are few, and its beginnings are looked up by an equi-join. Up to
    MOST_ALONE keywords are ranges of the sorted index too, so that their pages alone are read.
    """
    some = [r[0] for r in each.limit(MOST_ALONE + 1).collect()]
    lengths = sorted({len(k) for k in some}) if len(some) <= MOST_ALONE else sorted(r[0] for r in each.select(F.length("kw")).distinct().collect())
    near = words.filter(ranges_of(some)) if len(some) <= MOST_ALONE else words
    begins = F.transform(F.array(*(F.lit(n) for n in lengths)) if lengths else F.array().cast("array<int>"), lambda n: F.when(F.length("word") >= n, F.substring("word", F.lit(1), n)))
    return join_small(near.withColumn("kw", F.explode(begins)).filter(F.col("kw").isNotNull()), each, "kw", rows=rows)


def full_text(nodes: DataFrame, kws: DataFrame, qid: str = "qid", limit: int = FULLTEXT_LIMIT, index: DataFrame | None = None, rows: int | None = None) -> DataFrame:
    """qid, id, name, label, score, n: nodes whose field words begin with a keyword, by idf summed over keywords hit.

    An external index scores as it likes; ours is defined as sum of idf(keyword) over matched keywords, ties by name and id.
    """
    words = word_index(nodes) if index is None else index
    plain = kws.select(qid, F.lower(F.regexp_replace("keyword", "[^a-zA-Z0-9]", "")).alias("kw")).filter(F.col("kw") != "").distinct()
    each = plain.select("kw").distinct()
    # words are looked up for the distinct keywords alone; who asked for them is joined to what was found
    found = by_prefix(words, each, rows).select("kw", "id", "name", "label").distinct()
    df = found.groupBy("kw").agg(F.count(F.lit(1)).alias("_df")).select("kw", idf(F.lit(nodes.count()), F.col("_df")).alias("w"))
    scored = found.join(df, "kw").join(plain, "kw").groupBy(qid, "id", "name", "label").agg(F.sum("w").alias("score")).withColumn("score", rounded(F.col("score")))
    w = Window.partitionBy(qid).orderBy(F.col("score").desc(), "name", "id")
    return scored.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= limit)


def question_keywords(questions: DataFrame, qid: str = "qid", text: str = "question") -> DataFrame:
    return questions.select(qid, F.posexplode(keywords(F.col(text))).alias("kw_no", "keyword"))


def context_lines(nodes: DataFrame, edges: DataFrame, kws: DataFrame, qid: str = "qid", strategies=STRATEGIES, index: DataFrame | None = None) -> DataFrame:
    """qid, stage, ord, line: the context's lines of each stage, in order.

    kws (qid, kw_no, keyword). Stages: full text, employees, departments, projects, technologies, then each strategy.
    """
    hit = mentions(F.col("fields"), F.col("keyword")) | mentions(F.col("skills"), F.col("keyword"))
    n = kws.count()

    def matched(label: str) -> DataFrame:
        return join_small(nodes.filter(F.col("label") == label), kws, hit, rows=n).groupBy(qid, "id", "name", "props", "skills").agg(F.min("kw_no"))

    def gathered(rel: str, label: str, out: bool, text: Column, *more: str) -> DataFrame:
        a, b = ("src", "dst") if out else ("dst", "src")
        other = nodes.filter(F.col("label") == label).select(F.col("id").alias("_o"), F.col("name").alias("_other"))
        joined = edges.filter(F.col("rel") == rel).select(F.col(a).alias("id"), F.col(b).alias("_o"), *more).join(other, "_o")
        return joined.groupBy("id").agg(F.array_sort(F.collect_set(text)).alias("_got"))

    def add(df: DataFrame, got: DataFrame, prefix: str, sep: str = ", ") -> DataFrame:
        joined = df.join(got, "id", "left")
        return joined.withColumn("line", F.concat("line", F.when(F.col("_got").isNull(), F.lit("")).otherwise(F.concat(F.lit(prefix), F.array_join("_got", sep))))).drop("_got")

    prop = lambda k: F.coalesce(F.col("props")[k], F.lit(""))
    emp = matched("Employee").withColumn("line", F.concat(F.lit("Employee "), "name", F.lit(" ("), prop("title"), F.lit(")")))
    emp = add(emp, gathered("REPORTS_TO", "Employee", True, F.col("_other")), " reports to ")
    emp = emp.withColumn("line", F.concat("line", F.when(F.size(F.coalesce("skills", F.array().cast("array<string>"))) > 0, F.concat(F.lit(". Skills: "), F.array_join("skills", ", "))).otherwise(F.lit(""))))
    emp = add(emp, gathered("WORKS_ON", "Project", True, F.format_string("Works on %s as %s (%s%% allocation)", "_other", "role", F.col("allocation_pct").cast("string")), "role", "allocation_pct"), ". ", ". ")
    dept = matched("Department").withColumn("line", F.concat(F.lit("Department "), "name", F.lit(" ("), prop("headcount"), F.lit(" headcount)")))
    for rel, label, prefix in (("HAS_TEAM", "Team", ". Teams: "), ("COLLABORATES_WITH", "Department", ". Collaborates with: "), ("OWNS_PROJECT", "Project", ". Owns projects: ")):
        dept = add(dept, gathered(rel, label, True, F.col("_other")), prefix)
    proj = matched("Project").withColumn("line", F.concat(F.lit("Project "), "name", F.lit(" (status: "), prop("status"), F.lit(")")))
    proj = add(proj, gathered("USES_TECHNOLOGY", "Technology", True, F.col("_other")), ". Uses technologies: ")
    tech = matched("Technology").withColumn("line", F.concat(F.lit("Technology "), "name", F.lit(" ("), prop("category"), F.lit("): "), prop("description")))
    first = full_text(nodes, kws, qid, index=index, rows=n).select(qid, F.lit(1).alias("stage"), F.format_string("%08d", "n").alias("ord"), F.concat(F.lit("Found entity: "), "name", F.lit(" ["), "label", F.lit(" ]")).alias("line"))
    out = first
    for stage, df in enumerate((emp, dept, proj, tech), 2):
        out = out.unionByName(df.select(qid, F.lit(stage).alias("stage"), F.col("id").alias("ord"), "line"))
    each = kws.select("keyword").distinct()
    for stage, strategy in enumerate(strategies, 6):
        lines = strategy(nodes, edges, each, n).join(kws, "keyword")
        out = out.unionByName(lines.select(qid, F.lit(6).alias("stage"), F.format_string("%08d %02d %08d", "kw_no", F.lit(stage), "n").alias("ord"), "line"))
    return out


def context(nodes: DataFrame, edges: DataFrame, questions: DataFrame, qid: str = "qid", most: int = CONTEXT_NODES, strategies=STRATEGIES, index: DataFrame | None = None) -> DataFrame:
    """qid, context, n_lines: distinct lines in order of appearance, at most 3 * most, between header and footer."""
    lines = context_lines(nodes, edges, question_keywords(questions, qid), qid, strategies, index)
    once = lines.groupBy(qid, "line").agg(F.min(F.struct("stage", "ord")).alias("at"))
    kept = once.withColumn("n", F.row_number().over(Window.partitionBy(qid).orderBy("at", "line"))).filter(F.col("n") <= 3 * most)
    body = kept.groupBy(qid).agg(F.count(F.lit(1)).alias("n_lines"), F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: F.concat(F.lit("• "), x["line"])).alias("b"))
    text = F.concat(F.lit(HEADER + "\n"), F.array_join("b", "\n"), F.lit("\n" + FOOTER))
    return questions.select(qid).join(body, qid, "left").select(qid, F.coalesce(text, F.lit(NOTHING)).alias("context"), F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"))


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """label, n of each node label, and of all nodes and relationships."""
    return (
        nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
        .unionByName(nodes.agg(F.lit("nodes").alias("label"), F.count(F.lit(1)).alias("n")))
        .unionByName(edges.agg(F.lit("relationships").alias("label"), F.count(F.lit(1)).alias("n")))
    )


def export(nodes: DataFrame, edges: DataFrame, most_nodes: int = 2000, most_links: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of a drawing, named nodes only, in a fixed order."""
    n = nodes.filter(F.col("id").isNotNull() & F.col("name").isNotNull()).select("id", "label", "name").orderBy("label", "id").limit(most_nodes)
    links = edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), F.col("rel").alias("type")).orderBy("type", "source", "target").limit(most_links)
    return n, links


# --- a small company to try things on


def seed(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a made-up company: 37 nodes (1 company, 3 departments, 6 teams, 10 employees, 5 projects,
    12 technologies) and 74 edges, by rule."""
    labels = {"Company": 1, "Department": 3, "Team": 6, "Employee": 10, "Project": 5, "Technology": 12}
    letter = dict(zip(labels, "CDTEPK"))
    nodes = []
    for label, n in labels.items():
        for i in range(n):
            name = f"{label} {i + 1}"
            skills = [f"Technology {k % 12 + 1}" for k in (i, i + 3)] if label == "Employee" else []
            nodes.append((f"{letter[label]}{i}", label, name, [name, f"{name} of the company"], skills, {"title": f"Role {i % 4}"} if label == "Employee" else {}))
    edges = [("C0", f"D{i}", "HAS_DEPARTMENT") for i in range(3)] + [(f"D{i % 3}", f"T{i}", "HAS_TEAM") for i in range(6)]
    edges += [(f"T{i % 6}", f"E{i % 10}", "HAS_MEMBER") for i in range(11)]  # one employee is in two teams
    edges += [(f"E{i + 1}", f"E{i // 2}", "REPORTS_TO") for i in range(8)] + [(f"D{i % 3}", f"P{i}", "OWNS_PROJECT") for i in range(5)]
    edges += [(f"E{i % 10}", f"P{(i + i // 10) % 5}", "WORKS_ON") for i in range(19)]
    edges += [(f"D{i % 3}", f"D{(i + 1 + i // 3) % 3}", "COLLABORATES_WITH") for i in range(5)]
    edges += [(f"P{i % 5}", f"K{i % 12}", "USES_TECHNOLOGY") for i in range(17)]
    rows = [(a, b, rel, "Contributor" if rel == "WORKS_ON" else None, None, 10 * (i % 10) if rel == "WORKS_ON" else None) for i, (a, b, rel) in enumerate(edges)]
    return (
        spark.createDataFrame(nodes, "id string, label string, name string, fields array<string>, skills array<string>, props map<string,string>"),
        spark.createDataFrame(rows, "src string, dst string, rel string, role string, since string, allocation_pct int"),
    )


def stored(spark: SparkSession, path: str, make) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) kept at path, which the first call writes from make(): nodes in a folder for each label, sorted by name
    in their files, edges in one for each kind. A lookup or a hop reads the folders and row groups that it asks for."""
    made: list[tuple[DataFrame, DataFrame]] = []

    def one(i: int) -> DataFrame:
        if not made:
            made.append(make())
        return made[0][i].sortWithinPartitions(*(("label", "name") if i == 0 else ("rel", "src")))

    n = built_once(spark, f"{path}/nodes", lambda: one(0), ("label",))
    e = built_once(spark, f"{path}/edges", lambda: one(1), ("rel",))
    return n.select("id", "label", "name", "fields", "skills", "props"), e.select("src", "dst", "rel", "role", "since", "allocation_pct")


def save(old: tuple[DataFrame, DataFrame] | None, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph after saving nodes and edges with all that belongs to them: known ids and known edges are replaced."""
    if old is None:
        return nodes.dropDuplicates(["id"]), edges.dropDuplicates(["src", "dst", "rel"])
    key = ["src", "dst", "rel"]
    n, e = nodes.dropDuplicates(["id"]), edges.dropDuplicates(key)
    return old[0].join(n.select("id"), "id", "left_anti").unionByName(n), old[1].join(e.select(*key), key, "left_anti").unionByName(e)
