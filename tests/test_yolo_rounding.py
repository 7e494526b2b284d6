"""Label files whose numbers are read back as they were."""

from __future__ import annotations

from trackloom.plans import files_and_edits
from trackloom.sources import readers, writers


def test_a_share_just_below_a_half_is_rounded_down(spark, tmp_path, monkeypatch):
    k = spark.createDataFrame([(1, 0, 1.6, 1.0, 2), (1, 1, 32.16, 2.0, 2)], "image_id long, kp int, x double, y double, v int")
    images = spark.createDataFrame([(1, "a", 128.0, 128.0)], "image_id long, file_name string, width double, height double")
    width = 32.16 / 128 - 1.6 / 128
    assert width < 0.23875
    writers.yolo_pose_lines(images, k, digits=None).select("value").write.text(str(tmp_path / "full"))
    assert readers.yolo_boxes(spark, str(tmp_path / "full")).first().w == width
    monkeypatch.setattr(files_and_edits, "_kp5", lambda *_: k)
    assert files_and_edits.yolo_files(spark, "").first().w == 0.2387
