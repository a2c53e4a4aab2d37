"""Work that follows what is asked for, and is dealt over the tasks."""

from pyspark.sql import functions as F

from addonscope.operators import data_files, fixes, rules, xml_records
from addonscope.plans.analyze import extract
from addonscope.session import scratch
from addonscope.streaming import events

SOURCE = """class A(models.Model):
    _name = 'a'
    def go(self):
        self.env['b'].search([])
        self.env.cr.commit()
"""


def test_findings_in_bodies_wait_for_no_other_table(make_files, monkeypatch):
    def never(files):
        raise AssertionError("not asked for")

    monkeypatch.setattr("addonscope.plans.analyze.xml_records.xml_elements", never)
    e = extract(make_files({"a.py": SOURCE, "v.xml": "<odoo/>"}))
    found = rules.detect(e, ["PERF003"]).collect()
    assert [(r.rule_id, r.line) for r in found] == [("PERF003", 4)]


def test_only_places_of_named_rules_are_looked_for(make_files):
    methods = extract(make_files({"a.py": SOURCE}))["methods"]
    assert {r.hit for r in rules._method_hits(methods, ["PERF003"]).collect()} == {"PERF003"}
    assert {r.hit for r in rules._method_hits(methods).collect()} == {"PERF003", "BAD005"}


def test_own_rule_on_bodies_sees_all_places(make_files):
    e = extract(make_files({"a.py": SOURCE}))
    own = {"PERF003": rules.RULES["PERF003"]}
    rules.register_rule(
        "OWN", "body", F.col("hit") == "BAD005", "info", "own", "t", "d", "s", line=F.col("hit_line"), rules=own
    )
    # the model of the place is what a registered rule is about
    found = {(r.rule_id, r.line) for r in rules.detect(e, ["PERF003", "OWN"], own).collect()}
    assert found == {("PERF003", 4), ("OWN", 5)}


def test_table_first_read_in_a_scratch_stays(make_files, spark):
    e = extract(make_files({"a.py": SOURCE}))
    with scratch(spark):
        assert e["items"].count() > 0
    assert e["items"].count() > 0

def test_xml_of_one_partition_is_spread(make_files):
    files = make_files({f"{i}.xml": f"<odoo><record id='r{i}' model='m'></record></odoo>" for i in range(64)})
    rows = xml_records.xml_elements(files.coalesce(1)).select("path", F.spark_partition_id().alias("part"))
    assert rows.count() == 64 and rows.select("part").distinct().count() > 1


def test_access_rows_of_one_partition_are_spread(make_files):
    files = make_files({f"{i}/access.csv": "id,model_id:id,perm_read\na,model_x,1\n" for i in range(64)})
    rows = data_files.access_rights(files.coalesce(1)).select("path", F.spark_partition_id().alias("part"))
    assert rows.count() == 64 and rows.select("part").distinct().count() > 1


def test_rewrites_of_one_partition_are_spread(make_files):
    e = extract(make_files({f"{i}.py": SOURCE for i in range(64)}).coalesce(1))
    fixed = fixes.fix_corpus(e["files"], rules.detect(e, ["BAD005", "PERF003"]))
    written = fixed.where(F.size("fixes") == 2).select(F.input_file_name().alias("file"))
    assert written.count() == 64 and written.distinct().count() > 1


def test_scan_analyzes_only_modules_that_folders_left_or_went_to(make_files, spark, monkeypatch, tmp_path):
    """Files of a batch are read once; a manifest that goes touches no module beside it, also after compaction."""
    source, out, small = (str(tmp_path / x) for x in ("log", "out", "small"))
    code = "class {0}(models.Model):\n    _name = '{0}.x'\n"
    plans = []

    def watched(files):
        plans.append(files._jdf.queryExecution().toString())
        return extract(files)

    monkeypatch.setattr(events, "extract", watched)
    schema = make_files({"x": ""}).schema.add("version", "integer").add("deleted", "boolean")

    def change(paths, version, deleted, store):
        rows = make_files(paths).withColumns({"version": F.lit(version), "deleted": F.lit(deleted)})
        rows.write.mode("append").parquet(source)
        events.incremental_scan(
            spark.readStream.schema(schema).parquet(source),
            lambda: events.latest_files(spark.read.schema(schema).parquet(source)), store, str(tmp_path / "state"),
        ).awaitTermination()

    files = {}
    for m in ("a", "b", "c", "c/in"):
        files |= {f"{m}/__manifest__.py": "{}", f"{m}/models/m.py": code.format(m[0])}
    change(files, 1, False, out)
    events.compact_findings(spark, out, small)
    change({"b/__manifest__.py": "", "b/models/m.py": ""}, 2, True, small)
    versions = spark.read.parquet(f"{small}/modules").where("batch = 1")
    # what is under no manifest goes to the longest module path
    assert {(r.module_path, r.whole) for r in versions.collect()} == {("b", False), ("c/in", False)}
    found = events.current_findings(spark, small).where("rule_id = 'SEC003'")
    assert sorted(r.module_path for r in found.collect()) == ["a", "c", "c/in"]
    assert len(plans) == 2 and not any("Join" in plan for plan in plans)


def test_moved_modules_are_both_ends_and_what_is_inside(spark):
    def folders(*rows):
        return spark.createDataFrame([("r", *row) for row in rows], "repo STRING, dir STRING, module_path STRING")

    before = folders(("a", "a"), ("a/m", "a"), ("b", "b"), ("gone", "g"), ("b/in", "b/in"), ("d", "d"))
    now = folders(("a", "a"), ("a/m", "a/m"), ("b", "b"), ("b/in", "b/in"), ("d", "b"), ("new", "n"))
    moved = events.moved_modules(before, now).collect()
    assert sorted(r.module_path for r in moved) == ["a", "a/m", "b", "b/in", "d", "g"]


def test_store_without_folders_is_analyzed_as_a_whole(spark, tmp_path):
    versions = [("r", "a", False), ("r", "b", False)]
    spark.createDataFrame(versions, "repo STRING, module_path STRING, whole BOOLEAN").write.parquet(
        str(tmp_path / "modules/batch=0"))
    dirs = spark.createDataFrame([("r", "a", "a"), ("r", "c", "c")], "repo STRING, dir STRING, module_path STRING")
    changed = spark.createDataFrame([("r", "c/m.py")], "repo STRING, path STRING")
    touched, whole = events._touched(spark, str(tmp_path), 1, dirs, changed)
    assert {r.module_path for r in touched.collect()} == {"a", "c"} and [r.repo for r in whole.collect()] == ["r"]
