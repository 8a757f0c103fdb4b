"""Records known by their place: files without ids, repeated records."""

import os
import tempfile

from tessera import api
from tessera.sources import files as SRC

#: the documented form of a sample: no id
SAMPLE = ('{"image": "images/%s.png", "conversations": [{"from": "human", "value": "<image>\\nWhat is %s?"},'
          ' {"from": "gpt", "value": "It is the %s one."}]}')


def folder_of(files):
    d = tempfile.mkdtemp(prefix="tessera-records-") + "/ann.jsonl"
    os.mkdir(d)
    for name, lines in files.items():
        with open(os.path.join(d, name), "w") as f:
            f.write("\n".join(lines) + "\n")
    return d


def test_records_are_numbered_file_by_file(spark):
    files = {f"part-{k}": [f'{{"n": "{k}-{i}"}}' for i in range(k * 7 + 1)] for k in range(5)}
    files["part-2"][3:3] = ["", "   "]                          # blank lines are no records
    files["part-3"][2] = "not json,"
    files["part-9"] = [f'{{"n": "{i}", "pad": "{"x" * 900}"}}' for i in range(3000)]
    want = [line for name in sorted(files) for line in files[name] if line.strip()]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")   # a file in many splits
    try:
        lines = SRC.annotation_lines(spark, folder_of(files))
        assert lines.rdd.getNumPartitions() > 5
        got = {r.record: r.line for r in lines.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [got[i] for i in range(len(want))] == want and len(got) == len(want)


def test_samples_without_ids_give_tokens_each(spark):
    d = folder_of({"a": [SAMPLE % (("x",) * 3), SAMPLE % (("x",) * 3), '{"conversations": [{"from": "human", "value": "hi"},'
                                                                       ' {"from": "gpt", "value": "yo yo"}]}']})
    records = SRC.read_annotations(spark, d)
    assert [r.id for r in records.collect()] == [None] * 3
    media = api.record_media(records)
    assert sorted((r.conv_id, r.kind, r.k, r.file) for r in media.collect()) == [(0, "image", 0, "images/x.png"), (1, "image", 0, "images/x.png")]
    sizes = spark.createDataFrame([("images/x.png", 1, 4, 4, 0.0)], "file string, gt long, gh long, gw long, sec double")
    rows = api.prepare(records, media.join(sizes, "file"), batch_size=4).toPandas()
    kept = rows[rows.label != -100].groupby("conv_id").size().to_dict()
    assert kept == {0: 5 + 2, 1: 5 + 2, 2: 2 + 2}
    packed = api.prepare(records, media.join(sizes, "file"), batch_size=4, packed=True).toPandas()
    assert sorted(packed.pos) == list(range(len(packed))) and (packed.label != -100).sum() == 18


def test_json_array_records_and_repeated_lines(spark):
    d = tempfile.mkdtemp(prefix="tessera-array-")
    line = SAMPLE % (("q",) * 3)
    with open(os.path.join(d, "a.json"), "w") as f:
        f.write(f"[{line},\n{line}, {line}]")
    got = SRC.read_annotations(spark, os.path.join(d, "a.json")).collect()
    assert sorted(r.record for r in got) == [0, 1, 2]
    listing = spark.createDataFrame([("root/other.png",)], "path string")
    checked, summary = api.validate_data(spark, folder_of({"l": [line, line, "broken,"]}), "root", listing=listing)
    s = summary.first()
    assert (s.total_entries, s.valid_entries, s.missing_media) == (3, 0, 2)
    assert s.sample_missing == "root/images/q.png\nroot/images/q.png"
    assert sorted(r.id for r in checked.collect()) == [0, 1, 2]
