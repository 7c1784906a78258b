"""Schemas of the tables that operators read and write (DDL)."""

TRACKS = (
    "video string, track_id int, crop string, n_frames int, peak_conf double, best_frame int, first_frame int, last_frame int,"
    " box array<int>, crop_candidates array<struct<crop:string,score:double,frame:int,box:array<int>>>"
)
OBJECTS = "video string, object_id int, rep_track_id int, rep_crop string, track_ids array<int>, peak_conf double"
DETECTIONS = "video string, frame int, track_id int, conf double, x1 double, y1 double, x2 double, y2 double, w int, h int"
OCR_TOKENS = "image_id string, ord int, text string, conf double, x1 double, y1 double, x2 double, y2 double"
ITEMS = (
    "video string, ord long, object_id long, status string, is_own boolean, brand string, model string, category string,"
    " sku_id string, article_codes string, ocr_conf double, method string, crop string"
)
CATALOG = (
    "ord long, sku_id string, brand_id string, brand_name string, is_own_brand boolean, category string, model_name string,"
    " article_codes array<string>, barcodes array<string>, aliases array<string>, reference_images array<string>"
)
PRESENCE = (
    "sku_key string, sku_id string, article_codes string, brand string, model string, category string, is_own boolean,"
    " evidence_objects bigint, object_ids array<bigint>, best_crop string, best_ocr_conf double, method string"
)
REPORT = (
    "video string, generated_at string, totals map<string,bigint>, by_brand map<string,bigint>, by_category map<string,bigint>,"
    f" by_model map<string,bigint>, by_brand_objects map<string,bigint>, sku_presence array<struct<{', '.join(f.replace(' ', ':', 1) for f in PRESENCE.split(', '))}>>"
)
LIVE_DETECTIONS = (
    "session_id string, seq long, ord int, x1 double, y1 double, x2 double, y2 double, conf double, recognized boolean,"
    " sharpness double, area double, productness double, signature array<double>"
)
FEEDBACK = "session_id string, ts timestamp, label string"
JOB_EVENTS = "job_id string, ts timestamp, sku_status string, sku_report string, note string"
YOLO_LABELS = "image_id string, line_no int, cls int, coords array<double>"
