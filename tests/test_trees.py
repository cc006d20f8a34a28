"""Source trees with pruned folders, and methods cut by their braces."""

from logloom.sources import trees

FILE = """class A {
  public static void one(int x) {
    if (x) { two() }
  }
  abstract void two();
  def three() { s = "}" }
  List<String> four(a) {
    nothing closes this {
  }
  String one(y) { return "a second one" }
"""


def test_methods_by_braces(spark):
    rows = {(r.name, r.start_line): r.source for r in trees.methods(spark.createDataFrame([("f", FILE), ("g", "int last();"), ("h", None)], "path string, text string")).collect()}
    assert rows["one", 2] == "  public static void one(int x) {\n    if (x) { two() }\n  }"
    # an abstract method runs on to the next block; a quoted brace counts, as it does in the index
    assert rows["two", 5] == '  abstract void two();\n  def three() { s = "}' and rows["three", 6] == '  def three() { s = "}'
    assert rows["four", 7] == FILE[FILE.index("  List") :] and rows["one", 10].endswith("}") and rows["last", 1] == ""


def test_missing_methods(spark):
    files = spark.createDataFrame([("f", FILE), ("g", "void x() {}\nvoid x() { long enough now }")], "path string, text string")
    known = spark.createDataFrame([("f", "three"), ("g", "one")], "path string, name string")
    assert {(r.path, r.name, r.start_line) for r in trees.missing_methods(files, known).collect()} == {("f", "one", 2), ("f", "two", 5), ("f", "four", 7), ("g", "x", 2)}


def test_trees_without_pruned_folders(spark, tmp_path):
    for name in ("a.java", "src/b.groovy", "src/test/c.java", "build/d.java", "src/testing/e.java", "f.txt", "src/deep/target/x/g.java"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"line one of {name}\nline two\n")
    top = tmp_path / "build"  # the folder above may be called so
    got = {r.path.split(str(tmp_path))[1]: r.text for r in trees.read_tree(spark, str(tmp_path)).collect()}
    assert got.keys() == {"/a.java", "/src/b.groovy", "/src/testing/e.java"} and got["/a.java"] == "line one of a.java\nline two\n"
    assert trees.read_tree(spark, str(top)).count() == 1
