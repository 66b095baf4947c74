"""Explicit schemas of the tables that operators take and give; nothing is inferred."""

BLOCK = "struct<type:string,bbox:array<int>,content:string,order:int,figure_index:int,confidence:double>"
RAW_PAGES = "doc_id long, page int, raw string"
PAGE_RESULT = f"page_index int, markdown string, provider_raw string, warnings array<string>, blocks array<{BLOCK}>"
PARSE_RESPONSE = f"protocol_version int, engine string, model_id string, model_revision string, pages array<struct<page_index:int,markdown:string,provider_raw:string,warnings:array<string>,blocks:array<{BLOCK}>>>, timings map<string,double>"
PROVIDER_PAGE = "res struct<parsing_res_list:array<struct<block_bbox:array<double>,block_label:string,block_content:string,block_id:int,block_order:int>>>"
LAYOUT_BLOCK = "struct<type:string,bbox:array<int>,content:string,image:string,fs:double,bold:boolean,vertical:string>"
LAYOUT_PAGE = f"page int, width int, height int, fonts_v string, blocks array<{LAYOUT_BLOCK}>"
FIGURE_BOX = "x1 int, y1 int, x2 int, y2 int, image_width int, image_height int"
JOB = "id string, filename string, mode string, dpi int, status string, created_at string, error string, warnings array<string>, engine string, model_id string, model_revision string, provider string, progress struct<phase:string,current_page:int,total_pages:int,chunk:int,total_chunks:int>"
GLOSSARY = "src string, ko string, policy string, first_unit string"
