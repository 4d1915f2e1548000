"""The parser's chunks and metadata on small files, and both as table operators."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators.parsed import chunk_files, extract_metadata, unique_chunks
from lodestone.parsing.chunker import chunk, estimate, preview
from lodestone.parsing.declarations import Source
from lodestone.parsing.metadata import FIELDS, metadata

SMALL = """using System;
using System.Collections.Generic;
using Alias = Other.Place;

namespace Shop.Core
{
    [Serializable]
    public class Basket : Store<Item>, IHold
    {
        public const int Most = 3;
        private static readonly Dictionary<string, List<int>> Seen = new(), Again = new();
        #region Numbers
        public int Size { get; set; } = 1;
        #endregion
        public string Label => $"{Size} of {"}"}";
        internal event EventHandler<Args> Changed;
        public enum Mode { None, Fast = 1, [Old] Slow }
        public Basket(int size) : base(size) { Size = size; }
        // adds up
        public override async Task<int> Sum(List<Item> items) { var t = new Total(); return Helper.Add((Money)t, "SELECT }"); }
        protected virtual (int, string) Pair() => (1, "b");
        class Inner { void Deep() { } }
    }
}
"""


def test_members_are_found():
    rows = chunk("src/Basket.cs", SMALL)
    classes = [r for r in rows if r["chunk_type"] == "class"]
    assert [(c["name"], c["namespace"]) for c in classes] == [("Basket", "Shop.Core")]
    names = "+".join(r["name"] for r in rows)
    assert all(n in names for n in ("Label", "Basket", "Sum", "Pair")) and "Deep" not in names
    last = SMALL.count("\n") + 1
    assert all(1 <= r["start_line"] <= r["end_line"] <= last and r["name"].strip() and r["content"].strip() for r in rows)
    assert [r["seq"] for r in rows] == list(range(len(rows)))


def test_shell_holds_no_bodies():
    shell = chunk("src/Basket.cs", SMALL)[0]["content"]
    assert "Most = 3" in shell and "enum Mode" in shell and "get; set;" in shell and "Helper" not in shell


@pytest.mark.parametrize("text", ["", "  \n\t", None])
def test_blank(text):
    assert chunk("a.cs", text) == [] and all(v == [] for v in metadata(text).values())


def test_no_types_is_one_file_chunk():
    rows = chunk("a/b.x.cs", "using System;\n// nothing\n")
    assert [(r["chunk_type"], r["name"], r["start_line"], r["end_line"]) for r in rows] == [("file", "b.x", 1, 3)]


def test_small_members_merge_and_generated_properties_fold():
    text = "class A { void B() { } void C() { } int D { get { return 1; } } }"
    rows = chunk("A.cs", text)
    assert [(r["chunk_type"], r["name"]) for r in rows] == [("class", "A"), ("members", "B+C+D")]
    folded = chunk("A.Generated.cs", text)
    assert [r["name"] for r in folded] == ["A", "B+C"] and "int D { get; set; }" in folded[0]["content"]


def test_large_method_splits_between_statements():
    body = "\n".join(f"            if (a > {i}) {{ total += {i} * b; }} else {{ Log.Write(\"step {i} done ; }}\"); }}" for i in range(80))
    text = f"namespace N;\nclass A\n{{\n    public int Run(int a, int b)\n    {{\n{body}\n            return total;\n    }}\n}}\n"
    rows = [r for r in chunk("A.cs", text, ceiling=0) if r["chunk_type"] == "method"]
    assert len(rows) > 2 and [r["name"] for r in rows] == [f"Run~part{i}of{len(rows)}" for i in range(1, len(rows) + 1)]
    assert all(estimate(r["content"]) <= 420 for r in rows)
    for i in range(80):
        assert sum(f"step {i} done" in r["content"] for r in rows) == 1
    assert rows[0]["start_line"] == 6 and rows[-1]["end_line"] == 86 and rows[0]["namespace"] == "N"


def test_metadata_fields():
    m = metadata(SMALL)
    assert list(m) and set(m) == set(FIELDS) and len(FIELDS) == 27
    want = {
        "file_type": ["class"], "namespace": ["Shop.Core"], "class_name": ["Basket"], "class_modifiers": ["public"], "base_class": ["Store<Item>"],
        "interfaces": ["IHold"], "class_names": ["Basket", "Inner"], "property_names": ["Size", "Label"], "properties": ["int Size", "string Label"],
        "method_names": ["Sum", "Pair", "Deep"], "constructors": ["public Basket(int size)"], "overridden_methods": ["Sum"], "abstract_methods": [],
        "virtual_methods": ["Pair"], "async_methods": ["Sum"], "enum_values": ["Mode(Fast,Slow)"], "constants": ["Most"], "static_fields": ["Seen", "Again"],
        "attributes": ["Serializable", "Old"], "events": ["Changed"], "dictionaries": ["Dictionary<string, List<int>>"], "sql_operations": ["SELECT"],
        "usings": ["Other.Place", "System", "System.Collections.Generic"], "regions": ["Numbers"],
    }
    assert {k: m[k] for k in want} == want
    assert {"Args", "Dictionary", "EventHandler", "Helper", "IHold", "Item", "List", "Money", "Store", "Task", "Total"} <= set(m["referenced_types"])
    assert "Other" not in m["referenced_types"] and "int" not in m["referenced_types"]


@pytest.mark.parametrize("word,kind", [("interface", "interface"), ("struct", "struct"), ("record", "record"), ("record struct", "record struct"), ("static class", "static class"), ("abstract class", "abstract class"), ("enum", "enum"), ("", "other")])
def test_file_type(word, kind):
    assert metadata(f"public {word} X {{ }}" if word else "// no type")["file_type"] == [kind]


@pytest.mark.parametrize("text", ["class", "class {", "}}}}", "class A { void B( { }", 'class A { string s = "', "namespace", "using", "[", "class A<", "enum", "delegate", "event", "public", "class A : ", "new(", "a<b<c", "class A { int this[", "class A { ~", "~", "class A { operator", "/*", '$"{', "record", "using;"])
def test_broken_text_does_not_crash(text):
    Source(text)
    chunk("a.cs", text)
    metadata(text)


def test_every_cut_of_a_file_parses():
    for i in range(0, len(SMALL), 7):
        chunk("a.cs", SMALL[:i])
        metadata(SMALL[:i])
        metadata(SMALL[i:])


def test_preview_words():
    assert preview("a  b\nc d", 3) == "a  b\nc" and preview("a b ", 2) == "a b " and preview("", 2) == ""


def test_tables(spark):
    df = spark.createDataFrame([(1, "src/Basket.cs", SMALL), (2, "b.cs", None), (3, "c.cs", "class X { } class X { }"), (4, None, "class Y { }")], "file_id long, file_path string, content string")
    c = chunk_files(df)
    assert {r.file_id for r in c.collect()} == {1, 3, 4}
    kept, others = unique_chunks(c)
    assert others.count() == 1 and kept.count() + 1 == c.count()
    assert c.agg(F.max(F.length("content"))).first()[0] <= 5000
    m = {r.file_id: r for r in extract_metadata(df).collect()}
    assert m[1].properties == "int Size | string Label" and m[2].class_name == "" and len(m) == 4
    assert chunk_files(df.limit(0)).count() == 0 and extract_metadata(df.limit(0)).count() == 0


def test_files_of_one_small_table_are_parsed_by_many_tasks(spark):
    """A table of few bytes is read by one task, and may hold a million files."""
    code = F.concat(F.lit("namespace N { class C"), F.col("file_id").cast("string"), F.lit(" { int A() { return 1; } } }"))
    df = spark.range(3000).withColumnRenamed("id", "file_id").coalesce(1).withColumns({"file_path": F.lit("a.cs"), "content": code})
    for x in (chunk_files(df), extract_metadata(df)):
        tasks = x.select("file_id", F.spark_partition_id().alias("p")).groupBy("p").agg(F.countDistinct("file_id").alias("n")).collect()
        assert sum(r.n for r in tasks) == 3000 and len(tasks) > 1 and max(r.n for r in tasks) < 1000
