"""Every relational query by name, and its SQL. Doubles are rounded to six digits after all logic."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import functions as F

from boxwright.operators import colors, decisions, geometry, instances, kernels, labels, lint, positions, reports, shapes

_MODULES = (lint, geometry, positions, instances, reports, colors, decisions, kernels, labels, shapes)
#: Double columns of each query.
_DOUBLES = {
    "annotation_progress": "percent", "yolo_to_corners": "x1 y1 x2 y2", "corners_to_yolo": "x y w h", "letterbox_boxes": "x1 y1 x2 y2", "padded_resize_boxes": "x y w h", "automl_rows": "x_min y_min x_max y_max",
    "best_detection_per_class": "conf", "box_statistics": "cx cy sigma_cx sigma_cy", "auto_tolerance": "tolerance", "greedy_match": "dist", "normal_model": "mean std", "last_metrics": "value", "epoch_log_parse": "box_loss", "epoch_log_losses": "box_loss cls_loss dfl_loss",
    "color_channel_stats": "mean min max p10 p90", "color_running_stats": "mean min max p10 p90",
    "color_fast_paths": "black_confidence yellow_ratio", "color_green_share": "green_ratio", "color_hue_similarity": "similarity", "color_summary": "accuracy", "cluster_boxes": "cx cy", "nearest_vertex": "dist", "user_ratios": "p90 ratio", "mask_scores": "metric", "augmented_boxes": "x y w h", "color_scores": "score", "color_decisions": "confidence coverage", "createml_objects": "x1 y1 x2 y2",
}


def _rounded(name, query):
    columns = _DOUBLES.get(name, "").split()

    @wraps(query)
    def run(spark, sf_dir):
        df = query(spark, sf_dir)
        return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in columns}) if columns else df

    return run


def _rounded_sql(name, sql):
    columns = _DOUBLES.get(name, "").split()
    return f"SELECT * REPLACE ({', '.join(f'round({c}::DOUBLE, 6) + 0.0 AS {c}' for c in columns)}) FROM ({sql})" if columns else sql


QUERIES: dict = {name: _rounded(name, q) for m in _MODULES for name, q in m.QUERIES.items()}
ORACLE: dict = {name: _rounded_sql(name, q) for m in _MODULES for name, q in m.ORACLE.items()}
