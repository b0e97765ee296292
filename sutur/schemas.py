"""Record contracts as Spark schemas."""

from __future__ import annotations

BOX = "struct<x:int,y:int,width:int,height:int>"
SAMPLE = (
    "schema_version int, sample_id string, image_path string, text string, document_id string, page_id string, "
    "line_index int, tags array<string>"
)
DECISION = (
    "schema_version int, sample_id string, status string, tags array<string>, source_dataset_fingerprint string, "
    "note string, reviewer string"
)
REGION = f"page_index int, region_id string, bounding_box {BOX}, column_index int, reading_order_index int, region_kind string"
ISSUE = "code string, severity string, message string, sample_id string"
# Closed sets of names.
PARTITIONS = ("train", "validation", "test")
REVIEW_STATUSES = ("valid", "invalid", "needs_review")
REGION_KINDS = ("line", "spanning")
SEVERITIES = ("error", "warning")
