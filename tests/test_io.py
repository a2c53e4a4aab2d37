"""Sources, sinks, streams and the review store."""

import csv
import glob
import zipfile

from pyspark.sql import functions as F

from addonscope.operators import data_files, review, rules, xml_records
from addonscope.plans.analyze import extract
from addonscope.sources import corpus, sinks
from addonscope.streaming import events


def write(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())


def test_scan_rejects_by_kind_and_size(spark, tmp_path):
    write(tmp_path / "one/m/a.PY", "x = 1\n")
    write(tmp_path / "one/m/sp ace+x.xml", "<odoo/>")
    write(tmp_path / "two/big.csv", "x" * 200)
    write(tmp_path / "two/pic.png", b"\x89")
    write(tmp_path / "loose.txt", "t")
    files = {(r.repo, r.path): r for r in corpus.scan_corpus(spark, str(tmp_path), 100).collect()}
    assert set(files) == {("one", "m/a.PY"), ("one", "m/sp ace+x.xml"), ("", "loose.txt")}
    assert files["one", "m/a.PY"].type == "python" and files["one", "m/a.PY"].content == "x = 1\n"
    rejected = corpus.rejected_files(spark, str(tmp_path), 100).collect()
    assert sorted((r.path, r.message) for r in rejected) == [
        ("big.csv", "file larger than 100 bytes"), ("pic.png", "unsupported format")]


def test_scan_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("m/__manifest__.py", "{'name': 'Z'}")
        z.writestr("m/inner.zip", b"PK")
        z.writestr("m/pic.png", b"x")
        z.writestr("m/dir/", "")
    write(tmp_path / "broken.zip", b"no archive")
    rows = corpus.scan_archives(spark, str(tmp_path)).collect()
    assert [(r.repo, r.path, r.type) for r in rows] == [("a.zip", "m/__manifest__.py", "python")]


def test_given_type_wins(spark):
    df = spark.createDataFrame([("r", "a.txt", "xml", "x"), ("r", "b.py", "", "y")],
                               "repo STRING, path STRING, type STRING, content STRING")
    assert sorted((r.path, r.type) for r in corpus.classify(df).collect()) == [
        ("a.txt", "xml"), ("b.py", "python")]


def test_copies_are_kept_once(make_files):
    files = make_files({"a.py": "x = 1", "b.py": "y = 1"})
    many = files
    for _ in range(4):
        many = many.unionByName(many)
    assert corpus.unique_files(many).count() == 2


def test_malformed_xml_costs_one_error(make_files):
    text = (
        "<odoo><!-- <record id='c' model='ir.rule'/> -->"
        "<record id='ok' model='ir.ui.menu'><field name='name'>A &lt; B</field>"
        "<field name='parent_id' ref='root'/></record>"
        "<record id='bad' model='ir.ui.menu'><field name='name'>x</record>"
        "<menuitem id='t' name='a > b' parent='ok' sequence='x'/></odoo>"
    )
    elements = xml_records.xml_elements(make_files({"a.xml": text}))
    menus = {r.id: r for r in xml_records.menus(elements).collect()}
    assert set(menus) == {"ok", "t"}
    assert menus["ok"].name == "A < B" and menus["ok"].parent == "root" and menus["ok"].sequence == 10
    assert menus["t"].name == "a > b" and menus["t"].sequence is None
    assert xml_records.xml_errors(elements).count() == 1


def test_csv_headers(make_files):
    files = make_files({
        "x/other.csv": "ID,perm_read,model_id/id\n,1,\n\n#x,1,y\nr,false,model_a\n",
        "x/data.csv": "id,name\n1,a\n",
        "x/ir.model.access.csv": "# only a comment\n",
    })
    rows = data_files.access_rights(files).collect()
    assert [(r.id, r.model_id, r.perm_read, r.perm_write) for r in rows] == [
        ("r", "model_a", False, False)]


def test_issue_csv_quotes_everything(spark, make_files, tmp_path):
    e = extract(make_files({"m.py": "class A(models.Model):\n    _name = 'a'\n"}))
    sinks.write_issues_csv(rules.detect(e), str(tmp_path / "out"), "id")
    rows = []
    for part in glob.glob(str(tmp_path / "out/*.csv")):
        with open(part, encoding="utf-8") as f:
            raw = f.read()
        assert all(line.startswith('"') for line in raw.splitlines())
        rows += list(csv.reader(raw.splitlines()))
    assert sinks.ISSUE_HEADERS["id"] in rows
    assert {r[0] for r in rows} >= {"MIS001", "MIS002", "SEC003"}


def test_push_stream_takes_each_file_once(spark, tmp_path):
    source, audit, state = (str(tmp_path / x) for x in ("in", "audit", "state"))
    write(tmp_path / "in/1.json", '{"repository": {"full_name": "o/r"}, "ref": "refs/heads/dev"}\n')
    events.stream_push_events(spark, source, audit, state).awaitTermination()
    write(tmp_path / "in/2.json", '{}\n')
    events.stream_push_events(spark, source, audit, state).awaitTermination()
    details = sorted(r.details for r in spark.read.parquet(audit).collect())
    assert details == [
        "Repository: Unknown repo, Branch: main, Head Commit: No message",
        "Repository: o/r, Branch: dev, Head Commit: No message",
    ]


def test_incremental_scan_replaces_touched_modules(spark, make_files, tmp_path):
    """A later access file clears the finding of its module and leaves the others."""
    base = {
        "a/__manifest__.py": "{'license': 'x'}", "b/__manifest__.py": "{'license': 'x'}",
        "a/m.py": "class A(models.Model):\n    _name = 'a.x'\n    _description = 'd'\n",
        "b/m.py": "class B(models.Model):\n    _name = 'b.x'\n    _description = 'd'\n",
    }
    files = make_files(base)
    source = str(tmp_path / "in")

    def run():
        arrivals = spark.readStream.schema(files.schema).parquet(source)
        events.incremental_scan(
            arrivals, lambda: spark.read.schema(files.schema).parquet(source),
            str(tmp_path / "out"), str(tmp_path / "state"),
        ).awaitTermination()
        rows = events.current_findings(spark, str(tmp_path / "out")).where("rule_id = 'SEC003'")
        return sorted(r.entity for r in rows.collect())

    files.write.parquet(source)
    assert run() == ["a.x", "b.x"]
    make_files({"a/security/ir.model.access.csv": "id,model_id:id\nq,model_a_x\n"}).write.mode(
        "append").parquet(source)
    assert run() == ["b.x"]
    # A manifest in a subfolder moves files to a new module: no finding stays behind or doubles.
    make_files({
        "b/sub/__manifest__.py": "{'license': 'x'}",
        "b/sub/m.py": "class C(models.Model):\n    _name = 'c.x'\n    _description = 'd'\n",
    }).write.mode("append").parquet(source)
    assert run() == ["b.x", "c.x"]
    make_files({"b/__openerp__.py": "{}", "b/security/ir.model.access.csv": "id,model_id:id\nq,model_b_x\n"}).write.mode(
        "append").parquet(source)
    assert run() == ["c.x"]


def test_added_moved_and_deleted_files_equal_a_full_scan(spark, make_files, tmp_path):
    """Every rule and kind of file, after each batch; at last nothing is left."""
    from addonscope.session import work_dir

    code = (
        "class {0}(models.Model):\n    _name = '{0}.x'\n    state = fields.selection([('a', 'A')])\n"
        "    partner_id = fields.Many2one('res.partner')\n\n    def run(self):\n        self.env.cr.commit()\n"
        "        self.env.cr.execute('select %s' % self.id)\n        for r in self:\n            r.search([])\n"
        "        try:\n            pass\n        except:\n            pass\n"
    )
    view = "<odoo><record id='v' model='ir.ui.view'><field name='model'>{0}.x</field><field name='arch'><tree/></field></record></odoo>"
    access = "id,name,model_id:id,group_id:id,perm_read,perm_write,perm_create,perm_unlink\nq,q,model_{0}_x,,1,1,1,1\n"
    source, out = str(tmp_path / "log"), str(tmp_path / "out")
    schema = make_files({"x": ""}).schema.add("version", "integer").add("deleted", "boolean")
    live: dict[str, str] = {}
    version = [0]

    def full(rows):
        return sorted((r.rule_id, r.severity, r.file, r.line, r.entity, r.id) for r in rows.collect())

    def change(added, gone=()):
        version[0] += 1
        log = make_files(added).withColumns({"version": F.lit(version[0]), "deleted": F.lit(False)})
        if gone:
            dead = make_files(dict.fromkeys(gone, "")).withColumns({"version": F.lit(version[0]), "deleted": F.lit(True)})
            log = log.unionByName(dead) if added else dead
        log.write.mode("append").parquet(source)
        for path in gone:
            del live[path]
        live.update(added)
        events.incremental_scan(
            spark.readStream.schema(schema).parquet(source),
            lambda: events.latest_files(spark.read.schema(schema).parquet(source)), out, str(tmp_path / "state"),
        ).awaitTermination()
        found = full(events.current_findings(spark, out))
        assert found == (full(rules.detect(extract(make_files(live)))) if live else [])
        return {row[0] for row in found}

    files = {}
    for m in "ab":
        files |= {f"{m}/__manifest__.py": "{'name': '" + m + "'}", f"{m}/models/m.py": code.format(m),
                  f"{m}/views/v.xml": view.format(m), f"{m}/security/ir.model.access.csv": access.format(m)}
    files["loose.py"] = code.format("loose")
    first = change(files)
    assert first >= {"SEC001", "BAD005", "DAT001", "DEP007"} and "SEC003" in first
    # the model moves to another module, an access file goes
    change({"b/models/n.py": files["a/models/m.py"]}, ["a/models/m.py", "b/security/ir.model.access.csv"])
    # a changed text; a folder that only held what is deleted
    change({"b/models/m.py": code.format("b") + "    x = 1\n"}, ["a/views/v.xml"])
    # a module without its manifest belongs to another
    change({}, ["b/__manifest__.py"])
    events.compact_findings(spark, out, str(tmp_path / "small"))
    assert full(events.current_findings(spark, str(tmp_path / "small"))) == full(events.current_findings(spark, out))
    change({}, sorted(live))
    left = spark._jvm.java.io.File(f"{work_dir(spark)}/{spark.sparkContext.applicationId}").list() or []
    assert not [name for name in left if name.startswith("scratch-")]


def test_bad_archives_leave_rows(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "bad.zip").write_bytes(b"no zip")
    with zipfile.ZipFile(tmp_path / "r" / "good.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("m/a.py", "x = 1\n")
        z.writestr("m/b.py", "y" * 500)
    errors = corpus.archive_errors(spark, str(tmp_path), 400).collect()
    assert sorted((r.path, r.message) for r in errors) == [
        ("bad.zip", "not a readable archive"), ("good.zip/m/b.py", "file larger than 400 bytes")]
    assert {r.path for r in corpus.scan_archives(spark, str(tmp_path)).collect()} == {"m/a.py", "m/b.py"}


def test_menus_of_two_modules_with_one_id(spark, make_files):
    from addonscope.operators import graph

    def menus(root, child):
        return (f"<odoo><menuitem id='root' name='{root}'/><menuitem id='kid' name='{child}' parent='root'/></odoo>")

    e = extract(make_files({
        "m1/__manifest__.py": "{}", "m2/__manifest__.py": "{}",
        "m1/v.xml": menus("R1", "K1"), "m2/v.xml": menus("R2", "K2"),
        "m2/w.xml": "<odoo><menuitem id='far' name='F' parent='m1.kid'/></odoo>",
    }))
    paths = {r.menu_path for r in graph.menu_paths(e["menus"]).collect()}
    assert paths == {"R1", "R1 / K1", "R2", "R2 / K2", "R1 / K1 / F"}


def test_users_and_roles(spark):
    logins = spark.createDataFrame(
        [("x", "X", None, None, 2), ("y", "Y", "y@", "p", 1), ("x", "X2", "x@", "", 3)],
        "external_id STRING, name STRING, email STRING, avatar STRING, seq INT")
    first = review.upsert_users(spark.createDataFrame([], review.USERS), logins)
    rows = {r.external_id: r for r in first.collect()}
    assert (rows["y"].id, rows["y"].role) == (1, "Admin")
    assert (rows["x"].id, rows["x"].role, rows["x"].name) == (2, "Viewer", "X2")
    changes = spark.createDataFrame([(1, "Viewer"), (2, "King"), (9, "Admin")], "id INT, role STRING")
    after, audit, refused = review.change_roles(first, changes, 1, "root")
    assert {r.id: r.role for r in after.collect()} == {1: "Viewer", 2: "Viewer"}
    assert [r.details for r in audit.collect()] == ["Changed user ID 1 (Y) role from Admin to Viewer"]
    assert sorted((r.id, r.reason) for r in refused.collect()) == [
        (2, "Invalid role"), (9, "User not found")]


def test_hot_repository_spreads(make_files):
    """One repository with all the files still fills every partition of the line work."""
    from addonscope.operators.python_source import lexed_lines

    files = make_files({f"m/f{i}.py": "x = 1\ny = 2\n" for i in range(200)})
    parts = lexed_lines(files).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(parts) >= 8 and max(r["count"] for r in parts) < 200
