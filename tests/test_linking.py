from noteloom.operators import linking


def test_correction_scan_returns_every_line(spark):
    lines = [f"line {i} has Term" for i in range(7)]
    files = spark.createDataFrame([("a", "\n".join([*lines, "other"])), ("b", "none")], "path string, text string")
    rows = linking.correction_scan(files, "term").collect()
    assert [(r["path"], r["hits"], r["lines"]) for r in rows] == [("a", 7, lines)]


def test_names_of_any_length(spark):
    docs = spark.createDataFrame([(1, "The Grand Unified Theory of Small Things, by ann lee. Ann Lee!"), (2, "grand unified"), (3, None)], "id long, text string")
    names = spark.createDataFrame([(10, "Grand Unified Theory of Small Things"), (11, "Ann Lee"), (12, "Unified"), (13, "...")], "entity_id long, name string")
    got = {(r["entity_id"], r["document_id"]): r["hits"] for r in linking.name_mentions(docs, names).collect()}
    assert got == {(10, 1): 1, (11, 1): 2, (12, 1): 1, (12, 2): 1}
    assert linking.name_mentions(docs, names.limit(0)).count() == 0


def test_tasks_by_names_of_several_words(spark):
    projects = spark.createDataFrame([(1, "Atlas Pipeline"), (2, "AI"), (3, "rail"), (4, "c++")], "project_id long, name string")
    tasks = spark.createDataFrame([(1, "Fix the atlas pipeline", None), (2, "Railway map", None), (3, "Use AI, now", ""), (4, "Fix atlas pipeline", "Project: AI"), (5, "x", "Project: none"), (6, None, None)], "task_id long, title string, description string")
    got = {(r["task_id"], r["project_id"], r["tier"]) for r in linking.match_tasks(tasks, projects).collect()}
    assert got == {(1, 1, 2), (2, 3, 2), (3, 2, 2), (4, 2, 1)}


def test_pieces_of_titles_are_never_broadcast(spark, tmp_path):
    """Titles look small as planned, but are cut into many pieces: it is the names, which are counted, that are broadcast."""
    spark.range(2000).selectExpr("id as task_id", "concat('plan alder ', id, ' birch') as title", "if(id % 5 = 0, 'Project: Birch', 'x') as description").write.parquet(f"{tmp_path}/tasks")
    spark.range(200_000).selectExpr("id % 3 as k").selectExpr("k as project_id", "element_at(array('alder', 'birch', 'oak'), int(k) + 1) as name").write.parquet(f"{tmp_path}/names")
    found = linking.match_tasks(spark.read.parquet(f"{tmp_path}/tasks"), spark.read.parquet(f"{tmp_path}/names").union(spark.range(0).selectExpr("id", "string(id)")).distinct())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") == 2 and "leftHint=(strategy=broadcast)" not in plan
    got = {(r.task_id, r.project_id, r.tier) for r in found.collect()}
    assert got == {(i, 1, 1) for i in range(0, 2000, 5)} | {(i, p, 2) for i in range(2000) if i % 5 for p in (0, 1)}


def test_texts_are_cut_once_and_sifted_by_first_tokens(spark):
    docs = spark.createDataFrame([(1, "the oak tree, the Oak  tree and oak"), (2, ""), (3, None), (4, "oak")], "id long, text string")
    names = spark.createDataFrame([(7, "Oak tree"), (8, "oak"), (9, "tree and oak"), (10, "?")], "entity_id long, name string")
    found = linking.name_mentions(docs, names)
    assert "size(regexp_extract_all(lower(coalesce(text" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.entity_id, r.document_id, r.hits) for r in found.collect()} == {(7, 1, 2), (8, 1, 3), (9, 1, 1), (8, 4, 1)}
