"""Schemas of the tables, stated; nothing is inferred."""

from __future__ import annotations

BOX = "struct<x:double,y:double,w:double,h:double>"
FIELDS = "struct<type:string,title:string,origin:string,destination:string,date:string,carrier:string,seat:string>"
OCR_WORDS = "doc_id long, ord int, text string, conf double, line int, x double, y double, w double, h double"
BARCODES = "doc_id long, ord int, is_valid boolean, format string, text string, corners array<struct<x:double,y:double>>"
LEG = "struct<pnr:string,from:string,to:string,carrier:string,flight:string,julian:int,cabin:string,seat:string>"
ASSET = "struct<hash:string,w:int,h:int>"
MANIFEST = (
    f"struct<tickets:array<struct<id:string,fields:{FIELDS},note:string,image:{ASSET},photo:{ASSET}>>,"
    "placements:array<struct<ticketId:string,x:double,y:double,rotation:double,scale:double,z:int>>>"
)
TICKETS = f"id string, fields {FIELDS}, sources map<string,string>, note string, blur_off boolean, has_photo boolean, width int, height int, version int, created_at timestamp"
COLLAGES = "id string, title string, visibility string, share_token string, updated_at timestamp"
PLACEMENTS = "collage_id string, ticket_id string, x double, y double, rotation double, scale double, z int"
IMAGES = "ticket_id string, kind string, bytes binary"
SHARES = "token string, owner_hash string, title string, manifest string, created_at timestamp, updated_at timestamp"
SHARE_ASSETS = "token string, hash string, bytes binary, content_type string, width int, height int, created_at timestamp"
RATE_EVENTS = "key string, at timestamp"
FRAMES = "camera_id string, ts timestamp, corners array<struct<x:double,y:double>>, score double"
