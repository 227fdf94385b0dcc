"""Explicit schemas of the documents; nothing is inferred from data."""

OPTION = "struct<id:string,text:string>"
QUESTION = (
    f"struct<id:string,number:string,type:string,stem:string,options:array<{OPTION}>,"
    "answer:array<string>,analysis:string,source_pages:array<string>,score:double>"
)
GROUP = f"struct<id:string,title:string,description:string,questions:array<{QUESTION}>>"
SECTION = (
    "struct<id:string,type:string,title:string,description:string,total_score:double,"
    f"score:double,questions:array<{QUESTION}>,groups:array<{GROUP}>>"
)
WARNING = "struct<pages:array<int>,error:string>"
SUMMARY = "struct<id:string,title:string,question_count:int>"
PAPER = (
    "id string,type string,title string,description string,exam_format string,"
    f"duration_minutes int,total_score double,sections array<{SECTION}>,"
    f"warnings array<{WARNING}>,superseded_by string,repaired_from string,"
    "source struct<file_name:string,page_count:int,source_page_count:int,"
    "collection_id:string,start_page:int,end_page:int>,"
    f"papers array<{SUMMARY}>"
)
OCR_DOCUMENT = (
    "id string,source struct<file_name:string,page_count:int,source_page_count:int,"
    "ocr_model:string,input_type:string,unit:string>,"
    "pages array<struct<page:int,text:string,image:string,extraction_method:string>>"
)
DRAFT = (
    "struct<answers:map<string,array<string>>,categories:map<string,array<string>>,"
    "notes:map<string,string>,marks:array<string>,duration_seconds:bigint,updated_at:timestamp>"
)
ATTEMPT = (
    "struct<id:string,submitted_at:timestamp,answers:map<string,array<string>>,"
    "duration_seconds:bigint,grade:struct<total_score:double>>"
)
SUBMISSION = (
    "record_id string,record_date string,file_name string,paper_id string,title string,"
    f"draft {DRAFT},attempts array<{ATTEMPT}>"
)
