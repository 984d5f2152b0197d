"""Table layouts."""

from __future__ import annotations

ATTRS = "array<struct<name:string,value:string>>"
DOCTYPE = "struct<name:string,public_id:string,system_id:string,force_quirks:boolean>"
#: Node columns after the page id. A descendant d of a has d.pre > a.pre and d.pre <= a.last.
NODE_COLUMNS = [
    ("pre", "int"), ("last", "int"), ("parent_pre", "int"), ("depth", "int"), ("kind", "string"), ("name", "string"), ("namespace", "string"),
    ("attrs", ATTRS), ("data", "string"), ("doctype", DOCTYPE), ("elem_idx", "int"), ("elem_cnt", "int"), ("type_idx", "int"), ("type_cnt", "int"),
    ("prev_elem_pre", "int"), ("at_root", "boolean"), ("is_empty", "boolean"), ("src_start", "int"), ("src_end", "int"), ("end_start", "int"),
    ("end_end", "int"), ("origin_offset", "int"), ("origin_line", "int"),
    ("origin_col", "int"), ("is_template_content", "boolean"), ("end_tag_present", "boolean"), ("self_closing", "boolean"),
]
NODES = ", ".join(f"{n} {t}" for n, t in NODE_COLUMNS)
EVENTS = f"seq int, event string, name string, attrs {ATTRS}, data string, public_id string, system_id string"
ERRORS = "seq int, code string, line int, column int, category string, message string"
