"""Sources and sinks on small files."""

import json
import os
import struct
import tempfile
import zlib

import pytest
from pyspark.sql import functions as F

from stitchwork.operators import filters, joins, pixels, repair
from stitchwork.rules import garments as G
from stitchwork.sources import readers, writers


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def put(folder, name, content):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb" if isinstance(content, bytes) else "w") as handle:
        handle.write(content)
    return path


def png(width, height, pixel):
    """RGB PNG from pixel(x, y)."""
    raw = b"".join(b"\0" + b"".join(bytes(pixel(x, y)) for x in range(width)) for y in range(height))
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0))
            + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_image_files(spark, folder):
    for name, data in [("a/x.jpg", b"1"), ("a/y.JPEG", b"22"), ("b/z.txt", b"3"), ("b/.hidden.png", b"4"), ("b/empty.png", b""),
                       ("b/part.png.tmp", b"5")]:
        put(folder, name, data)
    assert {r["filename"] for r in readers.image_files(spark, folder).collect()} == {"x.jpg", "y.JPEG"}


def test_partition_tree(spark, folder):
    put(folder, "Outfit/Men_Under_35/2_Average/a.jpg", b"1")
    row = readers.partition_tree(spark, folder).first()
    assert (row["stream"], row["demographic"], row["tier"]) == ("Outfit", "Men_Under_35", "2_Average")


def test_json_lines_skip_bad(spark, folder):
    path = put(folder, "log.jsonl", '{"index": 1, "file": "a"}\n\n{broken\n{"index": null, "file": "b"}\n')
    rows = readers.json_lines(spark, path, "index int, file string").collect()
    assert [(r["index"], r["file"]) for r in rows] == [(1, "a"), (None, "b")]


def test_json_map_manifest_variants(spark, folder):
    path = put(folder, "m.json", json.dumps({"cat": ["u1", "u2"], "dog": ["u3"]}))
    assert {(r["category"], r["position"], r["url"]) for r in readers.json_map_of_lists(spark, path).collect()} == {
        ("cat", 0, "u1"), ("cat", 1, "u2"), ("dog", 0, "u3")}
    path = put(folder, "manifest.json", json.dumps({"a.png": {"prompt": "p", "category": "c", "tier": "t", "seed": 3, "row": {"k": "v"}}}))
    row = readers.manifest(spark, path).first()
    assert (row["filename"], row["prompt"], row["seed"], row["row"]["k"]) == ("a.png", "p", 3, "v")
    path = put(folder, "variants.json", json.dumps({"v1": {"prompt_append": "x", "extra_negative": ""}}))
    assert [tuple(r) for r in readers.variants(spark, path).collect()] == [("v1", "prompt_append", "x")]


def test_schema_files(spark, folder):
    paths = writers.write_schema_files(folder)
    schema = readers.schema_file([p for p in paths if "Men_Outfit" in p][0])
    assert schema["formality"].metadata["classes"] == G.FORMALITY_CLASSES and schema["score"].dataType.typeName() == "double"
    assert not any(n.startswith("requested_") for n in schema.names) and schema["formality"].metadata["loss_weight"] == 0.5


def test_discover_labels(spark, folder):
    pref, raw = f"{folder}/qa", f"{folder}/raw"
    assert readers.discover_labels(spark, "Men_Outfit", pref, raw)["available"] is False
    put(folder, "raw/labels_Men_Outfit.csv", "filename,score\na.png,3\nb.png,4\n")
    put(folder, "raw/images/a.png", b"1")
    found = readers.discover_labels(spark, "Men_Outfit", pref, raw)
    assert found["source"] == "raw_generated" and found["rows"].count() == 2 and "unfiltered" in found["warning"]
    put(folder, "qa/labels_Men_Outfit_measured.csv", "filename,score,qa_pass\na.png,3,1\nb.png,4,0\n")
    found = readers.discover_labels(spark, "Men_Outfit", pref, raw)
    assert found["source"] == "qa_processed" and [r["filename"] for r in found["rows"].collect()] == ["a.png"]


def listing(posts):
    return json.dumps({"data": {"after": None, "children": [{"kind": "t3", "data": p} for p in posts]}})


@pytest.mark.parametrize("posts,want", [
    ([{"id": "1", "url": "https://i.redd.it/img1.jpg", "is_video": False},
      {"id": "2", "url_overridden_by_dest": "https://i.imgur.com/img2.png", "url": "https://reddit.com/x"},
      {"id": "3", "url": "https://v.redd.it/vid123", "is_video": True},
      {"id": "4", "title": "[deleted]", "url": "https://i.redd.it/deleted.jpg", "removed_by_category": "deleted"}],
     ["https://i.redd.it/img1.jpg", "https://i.imgur.com/img2.png"]),
    ([{"id": "g", "is_gallery": True, "gallery_data": {"items": [{"media_id": "m1"}, {"media_id": "m2"}]},
       "media_metadata": {"m1": {"status": "valid", "s": {"u": "https://p/1.jpg?w=1&amp;s=a"}},
                          "m2": {"status": "valid", "s": {"u": "https://p/2.png?w=1&amp;s=b"}}, "bad": {"status": "failed"}}}],
     ["https://p/1.jpg?w=1&s=a", "https://p/2.png?w=1&s=b"]),
    ([{"id": "e", "url": "https://blog/a", "preview": {"images": [{"source": {"url": "https://t/x.jpg?w=9&amp;s=1"}}]}}],
     ["https://t/x.jpg?w=9&s=1"]),
    ([{"id": "a", "url": "https://i/same.jpg"}, {"id": "b", "url": "https://i/same.jpg"}], ["https://i/same.jpg"])])
def test_listing_pages(spark, folder, posts, want):
    put(folder, "page.json", listing(posts))
    rows = readers.listing_urls(readers.listing_pages(spark, folder), F.lit(1)).orderBy("post_pos", "url_pos").collect()
    assert [r["url"] for r in rows] == want


def test_catalog(spark):
    lines = spark.createDataFrame([('"OUTFITS"',), ('"r/streetwear"',), ('{"category":"men","subreddit":"m","query":"suit"}',),
                                   ('{"folder":"reddit_outfits","subreddit":"OUTFITS"}',)], "value string")
    rows = readers.normalize_catalog(lines).collect()
    assert [r["category"] for r in rows] == ["reddit_OUTFITS", "reddit_streetwear", "men", "reddit_outfits"]
    whole = spark.createDataFrame([('{"a": "SubA", "b": {"subreddit": "SubB", "query": "q"}}',)], "value string")
    assert {(r["category"], r["subreddit"]) for r in readers.normalize_catalog_map(whole).collect()} == {("a", "SubA"), ("b", "SubB")}
    cat = readers.query_catalog(spark, [{"category": "x", "subreddit": "s", "query": "q"}, {"category": "y", "subreddit": "s"}]).collect()
    assert cat[0]["listing"] is None and cat[1]["listing"] == "hot" and cat[1]["limit"] == 40


def test_targets_refused(spark):
    tasks = spark.createDataFrame([("a",), ("b",)], "filename string")
    make = lambda *n: spark.createDataFrame([(x,) for x in n], "filename string")
    assert filters.resolve_targets(make("a"), tasks).count() == 1
    with pytest.raises(ValueError, match="duplicate"):
        filters.resolve_targets(make("a", "a"), tasks)
    with pytest.raises(ValueError, match="not_in_task_list"):
        filters.resolve_targets(make("zzz"), tasks)


@pytest.mark.parametrize("bucket,row,want", [
    ("fit_miss", {"actual_direction": "baggy", "actual_tier": "flaw_severe"}, {"fit_baggy": "2", "fit_tight": "0", "fit_tailored": "0"}),
    ("fit_miss", {"actual_direction": "neutral", "actual_tier": "polished"}, {"fit_baggy": "0", "fit_tight": "0", "fit_tailored": "1"}),
    ("facial_hair_style_miss", {"actual_style": "clean_shaven"},
     {"facial_hair_style": "clean_shaven", "facial_hair_untidy": "0", "facial_hair_groomed": "0"}),
    ("pattern_miss", {"upper_pattern": "unclear", "lower_pattern": "solid"}, {"lower_pattern": "solid"}),
    ("eyebrows", {"actual_tier": "bad"}, {})])
def test_corrections(spark, bucket, row, want):
    cols = ["upper_pattern", "lower_pattern", "actual_tier", "actual_style", "actual_hair_length", "actual_footwear_type", "actual_direction"]
    df = spark.createDataFrame([("f", *[row.get(c) for c in cols])], "filename string, " + ", ".join(f"{c} string" for c in cols))
    assert {r["column"]: r["new_value"] for r in repair.corrections(df, bucket).collect()} == want
    assert repair.skipped(df, bucket).first()["skipped"] == (0 if want else 1)


def test_corrections_are_consumed_once(spark):
    labels = spark.createDataFrame([("f", 0, 1), ("f", 1, 1), ("g", 0, 5)], "filename string, pos int, v int")
    edits = spark.createDataFrame([("f", "v", "2"), ("h", "v", "3")], "filename string, column string, new_value string")
    patched, diff, unmatched = joins.apply_corrections(labels, edits, ["v"], order=["pos"])
    assert {(r["filename"], r["pos"]): r["v"] for r in patched.collect()} == {("f", 0): 2, ("f", 1): 1, ("g", 0): 5}
    assert [tuple(r) for r in diff.collect()] == [("f", "v", "1", "2")] and [r[0] for r in unmatched.collect()] == ["h"]


def test_publish_and_audit(spark, folder):
    df = spark.range(3)
    assert writers.publish(df, f"{folder}/t") is None and not os.path.exists(f"{folder}/t")
    writers.publish(df, f"{folder}/t", write=True, version="1")
    writers.publish(spark.range(5), f"{folder}/t", write=True, version="2")
    assert readers_count(spark, folder) == 5 and writers.read_published(spark, f"{folder}/t", "1").count() == 3
    from stitchwork.operators.aggregates import audit_summary
    v = spark.createDataFrame([("valid", True, True, True, False), ("invalid", False, True, None, True)],
                              "verdict string, body_type_match boolean, face_match boolean, attribute_match boolean, severe_anatomy_defect boolean")
    writers.write_audit(v, audit_summary(v, 28000), f"{folder}/audit", "judge")
    doc = json.loads(spark.read.text(f"{folder}/audit/summary").first()[0])
    assert doc["sample_size"] == 2 and doc["summary"]["projected_invalid"] == 14000 and doc["summary"]["attribute_match_failed"] == 0


def readers_count(spark, folder):
    return writers.read_published(spark, f"{folder}/t").count()


def test_pixels(spark, folder):
    checker = lambda x, y: (255, 255, 255) if (x + y) % 2 else (0, 0, 0)
    torso = lambda x, y: (224, 172, 140) if y < 20 else ((28, 38, 68) if y < 50 else (172, 32, 32))
    corner = lambda x, y: (255, 255, 255) if (x < 8 or x >= 56) and (y < 8 or y >= 72) else (90, 60, 40)
    for name, img in {"grey.png": png(64, 80, lambda x, y: (128, 128, 128)), "check.png": png(64, 80, checker),
                      "black.png": png(64, 80, lambda x, y: (0, 0, 0)), "corner.png": png(64, 80, corner),
                      "person.png": png(64, 80, torso), "junk.png": b"not a png"}.items():
        put(folder, name, img)
    m = {r["filename"]: r for r in pixels.with_color_names(pixels.measure(readers.image_pixels(spark, folder))).collect()}
    assert m["grey.png"]["laplacian"] == 0.0 and m["grey.png"]["brightness"] == 128.0 and m["check.png"]["laplacian"] > 1000
    assert m["junk.png"]["readable"] is False and m["corner.png"]["white_corners"] and not m["black.png"]["white_corners"]
    assert m["person.png"]["measured_upper_color"] == "navy" and m["person.png"]["measured_lower_color"] == "red"
    labels = spark.createDataFrame([(n, "Men_Outfit", "navy", "red") for n in ("person.png", "junk.png", "gone.png", "black.png")],
                                   "filename string, category string, requested_upper_color string, requested_lower_color string")
    measured = pixels.with_color_names(pixels.measure(readers.image_pixels(spark, folder)))
    qa = {r["filename"]: r for r in pixels.qa_rows(labels, measured).collect()}
    assert qa["gone.png"]["qa_reasons"] == "image_file_missing" and qa["junk.png"]["qa_reasons"] == "unreadable_image"
    assert qa["person.png"]["color_match_upper"] == 1 and qa["person.png"]["color_match_lower"] == 1
    assert qa["black.png"]["qa_reasons"] == "blurry(var=0.0);brightness_out_of_range(0);possible_cropped_feet(std=0.0)"
    assert len(qa) == 4
