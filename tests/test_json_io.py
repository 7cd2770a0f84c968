import json
import os

from neardup.sources.json_io import read_manifest_json


def test_defaults_and_derived_pixels(spark, scratch):
    p = os.path.join(scratch, "m.json")
    with open(p, "w") as f:
        f.write(json.dumps({"path": "/a.png", "width": 1920, "height": 1080, "file_hash": ""}) + "\n")
        f.write(json.dumps({"path": "/b.png", "width": 10, "height": 10, "pixel_count": 7,
                            "quality_score": 75.5, "error": "bad"}) + "\n")
    rows = {r.path: r for r in read_manifest_json(spark, p).collect()}
    a, b = rows["/a.png"], rows["/b.png"]
    assert (a.pixel_count, a.file_size, a.bit_depth, a.quality_score) == (1920 * 1080, 0, 0, 0.0)
    assert a.file_hash is None and a.error is None          # "" means absent
    assert (b.pixel_count, b.quality_score, b.error) == (7, 75.5, "bad")
