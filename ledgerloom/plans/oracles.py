"""DuckDB SQL with the results of the registered queries.

The derived inputs are shared with the queries; the operators are written here
a second time, in plain SQL.
"""

from __future__ import annotations

from ledgerloom.functions import dates
from ledgerloom.operators.label_fields import RULES
from ledgerloom.plans import derived as d
from ledgerloom.schemas import COUNTRIES, RecordSchema

# Whitespace as Python sees it, for trim() and as a regex class.
WS_CHARS = "".join(
    chr(c)
    for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)
WS = " || ".join(f"chr({ord(c)})" for c in WS_CHARS)
WS_RE = "[\\t\\n\\v\\f\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
NO_ERROR = "cast(null as integer) as status, cast(null as varchar) as code, cast(null as varchar) as detail"
TOO_SHORT = "Extracted document text is insufficient"
TOO_LONG = "Compacted invoice text exceeds the configured input-token ceiling"
UNREADABLE = "PaddleOCR returned no readable text"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def compact(x: str) -> str:
    """Line by line, on text that is already normalised."""
    lines = f"string_split(replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))"
    squeezed = f"list_transform({lines}, lambda l: {strip('regexp_replace(l, ' + chr(39) + '[' + chr(92) + 't ]+' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')})"
    return f"array_to_string(list_filter({squeezed}, lambda l: l <> ''), chr(10))"


def fold(x: str) -> str:
    plain = f"regexp_replace({x}, '{WS_RE}+', '', 'g')"
    return f"replace(replace(lower({plain}), '{chr(0xDF)}', 'ss'), '{chr(0x3C2)}', '{chr(0x3C3)}')"


def clean_money(x: str) -> str:
    kept = f"regexp_replace({x}, '[^0-9.-]', '', 'g')"
    first = f"nullif(regexp_extract({kept}, '-?[0-9]+(\\.[0-9]+)?', 0), '')"
    shape = f"regexp_full_match({kept}, '-?([0-9]+\\.?[0-9]*|\\.[0-9]+)')"
    return f"case when {shape} then cast({kept} as decimal(24,8)) else cast({first} as decimal(24,8)) end"


def is_iso_date(x: str) -> str:
    week = f"cast(regexp_extract({x}, 'W([0-9]{{2}})', 1) as integer)"
    last = f"extract(week from make_date(cast(substring({x}, 1, 4) as integer), 12, 28))"
    return (
        f"coalesce(case when regexp_full_match({x}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') then try_strptime({x}, '%Y-%m-%d') is not null"
        f" when regexp_full_match({x}, '[0-9]{{8}}') then try_strptime({x}, '%Y%m%d') is not null"
        f" when regexp_full_match({x}, '[0-9]{{4}}(-W[0-9]{{2}}(-[1-7])?|W[0-9]{{2}}[1-7]?)') then {week} between 1 and {last}"
        " else false end, false)"
    )


ORACLES: dict[str, str] = {}

# --- pages and texts ---------------------------------------------------------

_HEADER = "'--- PAGE ' || cast(page_no as varchar) || ' ---' || chr(10)"

_BINDERS = " union all ".join(
    f"select {key} as doc_key, cast({page} as integer) as page_no, {strip('text')} as body from conversations" for key, page in d.BINDERS
)
ORACLES["page_assembly"] = f"""
with pages as ({_BINDERS}), docs as (
  select doc_key, max(page_no) as total_pages, max(page_no) > 20 as too_many,
    string_agg({_HEADER} || body, chr(10) || chr(10) order by page_no) filter (body <> '') as joined
  from pages group by doc_key
), routed as (select *, coalesce(length(joined), 0) < 40 as scanned from docs)
select doc_key, total_pages,
  case when too_many then null when scanned then 'paddleocr' else 'pymupdf' end as extraction_method,
  case when not too_many then scanned end as used_ocr,
  case when not too_many and not scanned then joined end as text,
  cast(case when not too_many and not scanned then length(joined) end as integer) as character_count,
  cast(case when too_many then 413 when scanned then 422 end as integer) as status,
  case when too_many then 'too_many_pages' when scanned then 'document_extraction_failed' end as code,
  case when too_many then 'PDF exceeds the 20-page limit' when scanned then '{UNREADABLE}' end as detail
from routed
"""

ORACLES["page_numbers"] = """
with p as (
  select cast(conv_id as varchar) as doc_key, turn as place from conversations
  union all select 'all-' || cast(conv_id % 3 as varchar), conv_id * 1000 + turn from conversations
)
select doc_key, place, cast(row_number() over (partition by doc_key order by place) as integer) as page_no from p
"""

_LAYERED = " union all ".join(
    f"select {key} as doc_key, cast({page} as integer) as page_no, {strip(digital)} as digital, {strip(ocr)} as ocr from conversations where {kept}"
    for key, page, digital, ocr, kept in d.LAYERED_PAGES
)
_ROUTED = f"""
with pages as ({_LAYERED}), joined as (
  select doc_key, max(page_no) as total_pages,
    coalesce(string_agg({_HEADER} || digital, chr(10) || chr(10) order by page_no) filter (digital <> ''), '') as digital_text,
    string_agg({_HEADER} || ocr, chr(10) || chr(10) order by page_no) as ocr_text,
    count(*) filter (ocr = '') as blank
  from pages group by doc_key
), routed as (
  select doc_key, total_pages, length(digital_text) < 40 as used_ocr,
    case when length(digital_text) >= 40 then digital_text when blank = 0 then ocr_text end as text,
    total_pages > 20 as too_many
  from joined
), failed as (
  select *, case when too_many then 413 when text is null then 422 end as status,
    case when too_many then 'too_many_pages' when text is null then 'document_extraction_failed' end as code,
    case when too_many then 'PDF exceeds the 20-page limit' when text is null then '{UNREADABLE}' end as detail
  from routed
)
"""

ORACLES["digital_routing"] = _ROUTED + """
select doc_key, case when used_ocr then 'paddleocr' else 'pymupdf' end as extraction_method, used_ocr,
  case when not too_many then text end as text, cast(case when not too_many then length(text) end as integer) as character_count,
  total_pages, cast(status as integer) as status, code, detail
from failed
"""

ORACLES["documents_needing_ocr"] = _ROUTED + """
select doc_key, total_pages as page_count from routed where used_ocr
"""

ORACLES["prepared_text"] = _ROUTED + f"""
, compacted as (
  select *, case when status is null then {compact('text')} end as body from failed
)
select doc_key, case when used_ocr then 'paddleocr' else 'pymupdf' end as extraction_method, total_pages,
  case when length(body) >= 20 and length(body) <= 32768 then body end as character_stored,
  cast(case when length(body) >= 20 and length(body) <= 32768 then length(body) end as integer) as character_count,
  cast(case when length(body) >= 20 and length(body) <= 32768 then greatest(1, (length(body) + 3) // 4) end as integer) as estimated_tokens,
  cast(case when status is not null then status when length(body) < 20 or length(body) > 32768 then 422 end as integer) as status,
  case when status is not null then code when length(body) < 20 or length(body) > 32768 then 'document_extraction_failed' end as code,
  case when status is not null then detail when length(body) < 20 then '{TOO_SHORT}' when length(body) > 32768 then '{TOO_LONG}' end as detail
from compacted
"""

ORACLES["preparation_envelopes"] = f"""
select true as success, 'req-' || doc_key as request_id, character_stored, total_pages, character_count
from ({ORACLES["prepared_text"]}) where character_stored is not null
"""

ORACLES["text_compaction"] = f"""
select doc_id, compacted, cast(length(compacted) as integer) as n_compacted
from (select doc_id, {compact(d.SPACED_TEXT_NORMAL)} as compacted from documents)
"""

ORACLES["token_ceiling"] = f"""
with c as (select doc_id, length({compact('text')}) as n from documents),
e as (select *, greatest(1, (n + 3) // 4) as tokens from c)
select doc_id, cast(case when n >= 20 and tokens <= 8192 then n end as integer) as character_count,
  cast(case when n >= 20 and tokens <= 8192 then tokens end as integer) as estimated_tokens,
  cast(case when n < 20 or tokens > 8192 then 422 end as integer) as status,
  case when n < 20 or tokens > 8192 then 'document_extraction_failed' end as code,
  case when n < 20 then '{TOO_SHORT}' when tokens > 8192 then '{TOO_LONG}' end as detail
from e
"""

ORACLES["evidence_fold"] = f"""
with p as (select doc_id, {fold('text')} as folded_text, {fold(d.PROBE)} as folded_probe from documents)
select doc_id, folded_probe, contains(folded_text, folded_probe) as is_found from p
"""

# --- uploads -----------------------------------------------------------------

ORACLES["file_kind"] = f"""
with u as (select {', '.join(d.UPLOAD_FACTS)}, {d.UPLOAD_HEAD} || substring(upper(hex(encode(text))), 1, 20) as head from documents),
k as (
  select *, case when starts_with(head, '255044462D') then 'pdf' when starts_with(head, '89504E470D0A1A0A') then 'png'
    when starts_with(head, 'FFD8FF') then 'jpeg' end as kind from u
), f as (
  select *, case
    when length > 15728640 then 'file_too_large' when length = 0 then 'empty_file'
    when kind is null then 'unsupported_file_type'
    when kind = 'pdf' and not opens then 'invalid_pdf' when kind = 'pdf' and needs_pass then 'encrypted_pdf'
    when kind = 'pdf' and page_count < 1 then 'empty_pdf' when kind = 'pdf' and page_count > 20 then 'too_many_pages'
    when kind <> 'pdf' and decoded_format is null then 'invalid_image'
    when kind <> 'pdf' and upper(decoded_format) <> upper(kind) then 'spoofed_file_type'
    when kind <> 'pdf' and width * height > 40000000 then 'image_too_large' end as code
  from k
)
select doc_id, kind, case when code is null then case when kind = 'pdf' then page_count else 1 end end as total_pages,
  cast(case when code in ('file_too_large', 'too_many_pages', 'image_too_large') then 413
    when code in ('unsupported_file_type', 'spoofed_file_type') then 415 when code is not null then 400 end as integer) as status,
  code,
  case code when 'file_too_large' then 'Upload exceeds the 15 MB limit' when 'empty_file' then 'The uploaded file is empty'
    when 'unsupported_file_type' then 'Only genuine PDF, JPG, JPEG, and PNG files are supported'
    when 'invalid_pdf' then 'The PDF is corrupted' when 'encrypted_pdf' then 'Password-protected PDFs are not supported'
    when 'empty_pdf' then 'The PDF has no pages' when 'too_many_pages' then 'PDF exceeds the 20-page limit'
    when 'invalid_image' then 'The image is corrupted'
    when 'spoofed_file_type' then 'The decoded image format does not match its file signature'
    when 'image_too_large' then 'Image dimensions exceed the configured pixel limit' end as detail
from f
"""

ORACLES["web_pages_rejected"] = """
select page_id, cast(null as varchar) as kind, cast(octet_length(encode(html)) as integer) as length, cast(415 as integer) as status,
  'unsupported_file_type' as code, 'Only genuine PDF, JPG, JPEG, and PNG files are supported' as detail
from pages
"""

ORACLES["ocr_extractor"] = """
select cast(doc_id as varchar) as doc_key, cast(1 as integer) as page_no, 'ocr' as layer, '' as text, 'unreadable' as failure
from documents where doc_id % 9 = 0
union all
select cast(doc_id as varchar), cast(n as integer), 'ocr', part, cast(null as varchar)
from (select doc_id, unnest(string_split(text, chr(10) || chr(10))) as part,
        generate_subscripts(string_split(text, chr(10) || chr(10)), 1) as n from documents where doc_id % 9 <> 0)
"""

# --- OCR layout --------------------------------------------------------------

ORACLES["ocr_layout"] = f"""
with recursive boxes as (select {', '.join(d.BOXES).replace(' as left', ' as l').replace(' as right', ' as r')} from lineitem),
good as (select *, {strip('text')} as t from boxes where {strip('text')} <> ''),
page as (select doc_key, median(height) as h, max(r) as pr, count(*) as n from good group by doc_key),
numbered as (select *, row_number() over (partition by doc_key order by top, l, ord, r, height, t) as rn from good),
walk as (
  select b.doc_key, b.rn, 1 as row_no, b.top as total, 1 as n from numbered b where rn = 1
  union all
  select b.doc_key, b.rn,
    case when abs(b.top - w.total / w.n) <= greatest(4.0, p.h * 0.65) then w.row_no else w.row_no + 1 end,
    case when abs(b.top - w.total / w.n) <= greatest(4.0, p.h * 0.65) then w.total + b.top else b.top end,
    case when abs(b.top - w.total / w.n) <= greatest(4.0, p.h * 0.65) then w.n + 1 else 1 end
  from walk w join numbered b on b.doc_key = w.doc_key and b.rn = w.rn + 1 join page p on p.doc_key = w.doc_key
),
cells as (
  select b.doc_key, w.row_no, b.l, b.rn, b.t, p.h, p.pr,
    lag(b.l) over o as prev_l,
    max(b.r) over (partition by b.doc_key, w.row_no order by b.l, b.rn rows between unbounded preceding and 1 preceding) as prev_r
  from numbered b join walk w on w.doc_key = b.doc_key and w.rn = b.rn join page p on p.doc_key = b.doc_key
  window o as (partition by b.doc_key, w.row_no order by b.l, b.rn)
),
marked as (
  select *, case when prev_l is null then ''
    when l - prev_r > greatest(12.0, h * 2) or (pr >= 500 and prev_l < pr * 0.5 and l >= pr * 0.5 and l - prev_r > h)
      or (pr >= 500 and l >= pr * 0.77 and l - prev_r > h * 0.75) then ' | ' else ' ' end || t as cell
  from cells
),
rws as (select doc_key, row_no, string_agg(cell, '' order by l, rn) as line from marked group by doc_key, row_no),
texts as (select doc_key, string_agg(line, chr(10) order by row_no) as text from rws group by doc_key)
select a.doc_key, coalesce(p.n, 0) as box_count, x.text,
  case when p.n is null then 'document_extraction_failed' end as code
from (select distinct doc_key from boxes) a left join page p on p.doc_key = a.doc_key left join texts x on x.doc_key = a.doc_key
"""

_GAP = "case when 2 + o_orderkey % 60 > 24 then ' | ' else ' ' end"
ORACLES["ocr_results"] = f"""
select o_orderkey, case when o_orderkey % 5 = 4
  then 'Invoice' || chr(10) || cast(o_orderkey as varchar) || chr(10) || 'Total' || chr(10) || {d.PRICE_TEXT}
  else 'Invoice | ' || cast(o_orderkey as varchar) || chr(10) || 'Total' || {_GAP} || {d.PRICE_TEXT} end as text
from orders
"""

ORACLES["ocr_boxes"] = f"""
with b as (
  select o_orderkey, unnest([
    {{'ord': 0, 'top': 10.0::double, 'l': 10.0::double, 'r': 80.0::double, 'height': 12.0::double, 'text': 'Invoice'}},
    {{'ord': 1, 'top': 11.0::double, 'l': (600 + o_orderkey % 200)::double, 'r': (700 + o_orderkey % 200)::double, 'height': 12.0::double, 'text': cast(o_orderkey as varchar)}},
    {{'ord': 3, 'top': 50.0::double, 'l': 10.0::double, 'r': 60.0::double, 'height': 12.0::double, 'text': 'Total'}},
    {{'ord': 4, 'top': 52.0::double, 'l': (62 + o_orderkey % 60)::double, 'r': (132 + o_orderkey % 60)::double, 'height': 12.0::double, 'text': {d.PRICE_TEXT}}}
  ]) as x from orders where o_orderkey % 5 <> 4
)
select o_orderkey, cast(x.ord as integer) as ord, x.top as top, x.l as "left", x.r as "right", x.height as height, x.text as text from b
"""

ORACLES["ocr_legacy_results"] = f"""
select o_orderkey, case when o_orderkey % 4 = 3 then ''
  else 'Invoice | ' || cast(o_orderkey as varchar) || chr(10) || 'Total' || {_GAP} || {d.PRICE_TEXT} end as text
from orders
"""

# --- amounts, dates, identifiers ---------------------------------------------

ORACLES["clean_money_texts"] = f"""
select o_orderkey, cast({clean_money('m')} as double) as amount
from (select o_orderkey, {d.MONEY_TEXT} as m from orders)
"""

ORACLES["iso_dates"] = f"""
select event_id, date_text, {is_iso_date('date_text')} as is_valid
from (select event_id, {d.DATE_TEXT} as date_text from events)
"""

ORACLES["printed_dates"] = """
select o_orderkey, case when o_orderkey % 9 < 8 then cast(cast(o_orderdate as date) as varchar) end as normalised from orders
"""

ORACLES["job_names"] = """
with n as (select event_id, 'loc_' || strftime(ts, '%Y%m%d_%H%M%S') || '_' || substring(sha256(props), 1, 8) as short_name from events)
select event_id, 'batches/' || short_name as batch_job_name, short_name from n
"""

ORACLES["request_ids"] = f"""
with r as (select page_id, {d.REQUEST_ID_CANDIDATE} as requested from pages),
k as (select *, regexp_full_match(requested, '[A-Za-z0-9._-]{{1,100}}') as is_kept from r)
select page_id, is_kept, case when is_kept then requested end as kept_id,
  cast(case when not is_kept then 36 end as integer) as new_id_length from k
"""

ORACLES["request_log"] = """
with r as (select event_id, event_id * 137 + 500 as micros from events where event_id % 4 <> 0)
select event_id, '/api/v1/invoices/extract' as path,
  case when micros % 1000 = 500 then micros // 1000 + (micros // 1000) % 2 else (micros + 500) // 1000 end as duration_ms
from r
"""

# --- records -----------------------------------------------------------------

ORACLES["items_flatten"] = """
select o_orderkey, cast(case when n > 0 then i end as integer) as position,
  case when n > 0 then case when (o_orderkey + i) % 3 = 2 or (o_orderkey + i) % 3 = 0 then cast(i as varchar) else 'S' || cast(i as varchar) end end as sr_no,
  case when n > 0 then 'item ' || cast(o_orderkey % 100 as varchar) || '.' || cast(i as varchar) end as description,
  case when n > 0 then cast(i * 10.25 as double) end as amount
from (select o_orderkey, o_orderkey % 4 as n, unnest(range(1, greatest(1, o_orderkey % 4) + 1)) as i from orders)
"""

ORACLES["items_nest"] = """
with r as (select o_orderkey, unnest(range(1, o_orderkey % 4 + 1)) as i from orders),
t as (select o_orderkey, i as place, 'item ' || cast(o_orderkey % 100 as varchar) || '.' || cast(i as varchar) as description from r),
u as (select * from t union all select -1 - cast(floor(o_orderkey / 64) as bigint), o_orderkey % 64 * 4 + place, description from t)
select o_orderkey, count(*) as n_items, case when count(*) <= 100 then string_agg(description, ',' order by place) end as descriptions,
  case when count(*) > 100 then 'List has more than 100 elements: ' || cast(count(*) as varchar) end as detail
from u group by o_orderkey
"""

_FLAT = " union all ".join(f"select {key} as doc_key, {place} as place, {d.FLAT_SERIAL} as sr_no from lineitem" for key, place in d.FLAT_ITEMS)
ORACLES["items_numbered"] = f"""
select doc_key, place, case when coalesce(sr_no, '') = '' then cast(row_number() over (partition by doc_key order by place) as varchar) else sr_no end as sr_no
from ({_FLAT})
"""


def _pan(pan: str, gst: str) -> str:
    clean = strip(gst)
    return f"case when coalesce({pan}, '') = '' and length({clean}) = 15 then upper(substring({clean}, 3, 10)) else {pan} end"


ORACLES["india_reconcile"] = f"""
with h as (select {', '.join(d.INDIA_HEADERS)} from orders),
i as (select doc_key, sum(amount) as s from (select {', '.join(d.INDIA_ITEMS)} from lineitem) group by doc_key),
t as (select doc_key, sum(cgst) as c, sum(sgst) as s from (select {', '.join(d.INDIA_TAXES)} from lineitem) group by doc_key),
a as (
  select h.*, case when taxable_amount is null and i.s > 0 then i.s else taxable_amount end as taxable,
    case when cgst_amount is null and t.c > 0 then t.c else cgst_amount end as cgst,
    case when sgst_amount is null and t.s > 0 then t.s else sgst_amount end as sgst
  from h left join i on i.doc_key = h.doc_key left join t on t.doc_key = h.doc_key
),
b as (select *, coalesce(cgst, 0) + coalesce(sgst, 0) + coalesce(igst_amount, 0) as taxes from a)
select doc_key, round(cast(taxable as double), 2) as taxable_amount, round(cast(cgst as double), 2) as cgst_amount,
  round(cast(sgst as double), 2) as sgst_amount, cast(coalesce(igst_amount, 0) as double) as igst_amount,
  round(cast(case when invoice_amount is null and taxes > 0 then taxable + taxes else invoice_amount end as double), 2) as invoice_amount,
  cast(coalesce(discount, 0) as double) as discount, cast(0 as double) as state_cess, cast(0 as double) as other_charges,
  {_pan('customer_pan', 'customer_gst')} as customer_pan, {_pan('vendor_pan', 'vendor_gst')} as vendor_pan,
  case when coalesce(invoice_date, '') = '' and coalesce(due_date, '') <> '' then due_date else invoice_date end as invoice_date,
  case when coalesce(irn_number, '') = '' then '0' else irn_number end as irn_number
from b
"""

ORACLES["india_records"] = """
with a as (
  select o_orderkey, case when o_orderkey % 4 = 0 then 7.0 else 10.5 + 0.1 * 0 + cast('0.0' as decimal(10,2)) + cast('1' || '0' || cast(o_orderkey % 10 as varchar) || '0' as decimal(10,2)) end as taxable
  from orders
)
select o_orderkey, cast(taxable as double) as taxable_amount, cast(1.5 as double) as cgst_amount, cast(1.5 as double) as sgst_amount,
  cast(taxable + 3 as double) as invoice_amount, '9983, 9984' as hsn_sac_code,
  case o_orderkey % 6 when 3 then '5' when 4 then 'abc' else '0' end as irn_number, '1,7,3' as serials, cast(4 as double) as total_quantity
from a
"""


def _warn(condition: str, text: str) -> str:
    return f"case when {condition} then '{text}' end"


def _trn_warn(name: str) -> str:
    return _warn(
        f"coalesce({name}, '') <> '' and not regexp_full_match({strip(name)}, '[0-9]{{15}}')",
        f"{name} must contain exactly 15 digits",
    )


def _evidence(name: str) -> str:
    return _warn(
        f"character_stored <> '' and coalesce({name}, '') <> '' and not contains(folded, {fold(name)})",
        f"{name} was not found in extracted_text",
    )


ORACLES["uae_validate"] = f"""
with r as (select {', '.join(d.UAE_RECORD)} from orders left join customer on o_custkey = c_custkey),
f as (select *, {fold('character_stored')} as folded from r),
w as (select o_orderkey, list_filter([
  {_warn("coalesce(vendor_name, '') = ''", 'vendor_name is missing')},
  {_warn("coalesce(invoice_no, '') = ''", 'invoice_no is missing')},
  {_warn("coalesce(invoice_date, '') = ''", 'invoice_date is missing')},
  {_warn("coalesce(net_amount, 0) = 0", 'net_amount is missing')},
  {_warn("coalesce(grand_total, 0) = 0", 'grand_total is missing')},
  {_warn("coalesce(vendor_trn_no, '') = ''", 'vendor_trn_no is missing')},
  {_trn_warn('vendor_trn_no')}, {_trn_warn('buyer_trn_no')},
  {_warn("coalesce(invoice_date, '') <> '' and not " + is_iso_date('invoice_date'), 'invoice_date is not a valid YYYY-MM-DD date')},
  {_warn("coalesce(currency, '') <> '' and not regexp_full_match(currency, '[A-Z]{3}')", 'currency must be a three-letter uppercase code')},
  {_warn("net_amount <> 0 and grand_total <> 0 and abs(net_amount + coalesce(total_tax, 0) - grand_total) > 0.02", 'subtotal, VAT, and grand_total do not balance')},
  {_evidence('invoice_no')}, {_evidence('vendor_trn_no')}, {_evidence('buyer_trn_no')}
  ], lambda x: x is not null) as ws from f)
select o_orderkey, len(ws) = 0 as is_valid, array_to_string(ws, '; ') as warnings from w
"""


def clean_json(x: str) -> str:
    fenced = f"nullif(regexp_extract({x}, '(?s)```(?:json)?{WS_RE}*(\\{{.*?\\}}){WS_RE}*```', 1), '')"
    braces = f"nullif(regexp_extract({x}, '(?s)\\{{.*\\}}', 0), '')"
    return strip(f"coalesce({fenced}, {braces}, {x})")


ORACLES["json_clean"] = f"""
select event_id, {clean_json('r')} as json from (select event_id, {strip(d.REPLY_TEXT)} as r from events)
"""

ORACLES["reply_envelopes"] = f"""
with e as (select event_id, user_id, {d.REPLY_STATUS} as http_status, {d.REPLY_BODY} as body, {strip(d.REPLY_TEXT)} as r, event_id % 11 as kind from events)
select event_id, case when kind > 2 then {clean_json('r')} end as json,
  case when kind > 3 then event_id when kind = 3 then 0 end as input_tokens,
  case when kind > 3 then user_id when kind = 3 then 0 end as output_tokens,
  case when kind > 3 then event_id + user_id when kind = 3 then 0 end as total_tokens,
  case when kind > 3 then event_id * 1234567 // 1000000 when kind = 3 then 0 end as execution_time_ms,
  cast(case when kind < 2 then 502 when kind = 2 then 500 end as integer) as status,
  case when kind < 2 then 'ollama_service_error' when kind = 2 then 'internal_error' end as code,
  case when kind < 2 then 'Ollama returned HTTP ' || cast(http_status as varchar) || ': ' || substring(body, 1, 200)
    when kind = 2 then 'An unexpected error occurred: reply is not JSON' end as detail
from e
"""

ORACLES["schema_strict"] = f"""
with e as (select event_id, user_id, event_id % 13 as kind, {d.STRICT_JSON} as j from events),
o as (select *, kind not in (8, 9, 10) as is_object from e),
t as (select *, case when is_object then json_type(j, '$.vendor_name') end as vt, case when is_object then json_type(j, '$.po_no') end as pt,
  case when is_object then json_type(j, '$.items') end as it from o),
p as (select *, array_to_string(list_filter(case when not is_object then ['$'] else [
    case when vt not in ('VARCHAR', 'NULL') then 'vendor_name' end,
    case when pt not in ('VARCHAR', 'NULL') then 'po_no' end,
    case when it is not null and it <> 'ARRAY' then 'items' end,
    case when kind = 4 then 'items.1.item' end, case when kind = 5 then 'items.0' end] end, lambda x: x is not null), ',') as problems from t)
select event_id, problems,
  case when problems = '' then case kind when 0 then 'v' when 11 then 'b' end end as vendor_name,
  case when problems = '' then case kind when 6 then null when 7 then 'USD' else 'AED' end end as currency,
  case when problems = '' then case kind when 0 then cast(1100 + user_id + 0.5 as double) when 11 then cast(user_id + 0.25 as double) end end as net_amount,
  case when problems = '' and kind = 6 then cast(100000 as double) end as grand_total,
  cast(case when problems = '' then case kind when 12 then 2 else 0 end end as integer) as n_items
from p
"""


def _label_sql(country: str) -> str:
    columns = []
    for rule in RULES[country]:
        # The patterns are plain regular expressions that both engines read.
        found = ", ".join(
            "nullif(regexp_extract(t, '" + p.replace("'", "''") + "', 1), '')" for p in rule.patterns
        )
        value = strip(f"coalesce({found}, null)")
        if rule.kind == "money":
            value = f"cast({clean_money(value)} as double)"
        elif rule.kind == "date":
            value = f"case when {value} is null then null when o_orderkey % 9 < 8 then cast(cast(o_orderdate as date) as varchar) else {value} end"
        columns.append(f"{value} as {rule.name}")
    return (
        f"select o_orderkey, {', '.join(columns)} from"
        f" (select *, {d.PRINTED_INVOICES[country]} as t from orders)"
    )


for _country in RULES:
    ORACLES[f"label_fields_{_country}"] = _label_sql(_country)

# --- jobs --------------------------------------------------------------------

_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S') || case when extract(microsecond from {0}) % 1000000 = 0 then '' else strftime({0}, '.%f') end || '+00:00'"

ORACLES["batch_status"] = f"""
with g as (
  select user_id, count(*) as n, count(*) filter (event_type <> 'error') as ok, min(ts) as a, max(ts) as b
  from events group by user_id
)
select 'batches/loc_' || cast(user_id as varchar) as batch_job_name,
  case when user_id % 2 = 0 then 'COMPLETED' else 'PROCESSING' end as state, n + user_id % 2 as total_items,
  ok as completed_items, n - ok as failed_items, {_ISO.format('a')} as created_at, {_ISO.format('b')} as updated_at
from g
"""
ORACLES["stream_batch_status"] = ORACLES["batch_status"]

ORACLES["batch_lookup"] = f"""
with r as (select event_id, user_id, {d.REQUESTED_JOB} as requested from events),
g as (select user_id, count(*) + user_id % 2 as total_items from events group by user_id)
select event_id, case when event_id % 6 < 5 then 'batches/loc_' || cast(r.user_id as varchar) end as batch_job_name,
  case when event_id % 6 < 5 then total_items end as total_items,
  cast(case when event_id % 6 = 5 then 404 end as integer) as status,
  case when event_id % 6 = 5 then 'Batch job ''' || requested || ''' was not found.' end as detail
from r join g on g.user_id = r.user_id
"""

ORACLES["batch_payloads"] = """
with p as (
  select doc_id, case when doc_id % 19 = 0 then [] when doc_id % 23 = 0 then string_split(text, ' ') else string_split(text, chr(10)) end as ls
  from documents
), f as (
  select *, case when len(ls) = 0 then 'body.items: List should have at least 1 item after validation, not 0'
    when len(ls) > 100 then 'body.items: List should have at most 100 items after validation, not ' || cast(len(ls) as varchar)
    when doc_id % 17 = 3 and len(ls) > 1 then 'body.items.1.text: Field required' end as detail from p
)
select 'batches/loc_' || cast(doc_id as varchar) as batch_job_name, cast(i - 1 as integer) as item_no,
  case when (i - 1) % 2 = 0 then cast(i - 1 as varchar) else 'c' || cast(i - 1 as varchar) end as custom_id, line as character_stored,
  cast(null as varchar) as detail
from (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as i from f where detail is null)
union all
select 'batches/loc_' || cast(doc_id as varchar), null, null, null, detail from f where detail is not null
"""

_UPLOAD_BLOB = f"unhex({d.UPLOAD_HEAD}) || encode(coalesce(text, ''))"
ORACLES["upload_files"] = f"""
with b as (select doc_id, {_UPLOAD_BLOB} as head, {d.UPLOAD_FILL} as fill from documents),
f as (select doc_id, head || encode(repeat('x', greatest(0, fill - octet_length(head)))) || encode(chr(10)) as content from b),
k as (
  select doc_id, cast(octet_length(content) as bigint) as length, octet_length(content) > 15728640 as large, md5(content) as content_md5,
    case when starts_with(hex(content), '255044462D') then 'pdf' when starts_with(hex(content), '89504E470D0A1A0A') then 'png'
    when starts_with(hex(content), 'FFD8FF') then 'jpeg' end as kind from f
)
select doc_id, length, case when not large then kind end as kind, case when not large then content_md5 end as content_md5,
  cast(case when large then 413 when kind is null then 415 end as integer) as status,
  case when large then 'file_too_large' when kind is null then 'unsupported_file_type' end as code,
  case when large then 'Upload exceeds the 15 MB limit' when kind is null then 'Only genuine PDF, JPG, JPEG, and PNG files are supported' end as detail
from k
"""
_PAYLOADS = """
with p as (
  select doc_id, case when doc_id % 19 = 0 then [] when doc_id % 23 = 0 then string_split(text, ' ') else string_split(text, chr(10)) end as ls
  from documents
), f as (
  select *, case when len(ls) = 0 then 'body.items: List should have at least 1 item after validation, not 0'
    when len(ls) > 100 then 'body.items: List should have at most 100 items after validation, not ' || cast(len(ls) as varchar)
    when doc_id % 17 = 3 and len(ls) > 1 then 'body.items.1.text: Field required' end as problem from p
)"""
ORACLES["payload_files"] = f"""{_PAYLOADS}, g as (
  select *, doc_id % 13 = 5 as broken, case when doc_id % 13 = 5 then 'body: JSON decode error' else problem end as detail from f
)
select doc_id, case when not broken then 'batches/loc_' || cast(doc_id as varchar) end as batch_job_name,
  cast(case when broken then 0 else len(ls) end as integer) as total_items,
  case when detail is null then md5(array_to_string(ls, chr(10))) end as texts_md5,
  cast(case when detail is not null then 400 end as integer) as status,
  case when detail is not null then 'invalid_request' end as code, detail
from g
"""
ORACLES["stream_batch_results"] = f"""{_PAYLOADS}, i as (
  select doc_id, len(ls) as n, unnest(ls) as line, generate_subscripts(ls, 1) - 1 as i from f where problem is null
), r as (
  select doc_id, n, case when i % 2 = 0 then '' else 'c' end || cast(i as varchar) as custom_id,
    doc_id % 4 < 3 and length(line) % 7 <> 3 and length(line) % 11 <> 5 as success, cast(length(line) as varchar) as v from i
)
select 'batches/loc_' || cast(doc_id as varchar) as batch_job_name, 'COMPLETED' as state, cast(any_value(n) as integer) as total_items,
  count(*) filter (where success) as completed_items, count(*) filter (where not success) as failed_items,
  count(*) as n_results, array_to_string(list_sort(list(custom_id || ':' || case when success then v else 'failed' end)), ',') as results
from r group by doc_id
"""

ORACLES["batch_results"] = f"""
with e as (select *, {d.BLOCK_OF_EVENT} as block from events)
select cast(block as varchar) as batch_job_name, count(*) as n_results,
  case when count(*) <= 100 then string_agg(cast(event_id as varchar) || ':' || cast(event_type <> 'error' as varchar), ',' order by ts, event_id) end as results,
  case when count(*) > 100 then 'Batch job has more than 100 items: ' || cast(count(*) as varchar) end as detail
from e group by block
"""

ORACLES["completion_join"] = f"""
with c as (select doc_id, {d.INVOICE_ID} as raw, {strip(d.INVOICE_ID)} as clean from labels),
v as (select *, length(raw) between 1 and 100 and length(clean) between 1 and 100 as ok from c)
select cast(v.doc_id as varchar) as doc_key, clean as invoice_id, n_chars, cast(null as varchar) as code
from v join documents on documents.doc_id = v.doc_id where ok
union all
select cast(doc_id as varchar), null, null, 'invalid_invoice_id' from v where not ok
"""

ORACLES["country_dispatch"] = """
select s_suppkey, n_name, case n_nationkey % 4 when 0 then 'uae' when 1 then 'usa' when 2 then 'india' end as country,
  cast(case n_nationkey % 4 when 0 then 20 when 1 then 24 when 2 then 27 else 0 end as integer) as n_fields
from supplier left join nation on s_nationkey = n_nationkey
"""

# --- errors and activity -----------------------------------------------------

_SOURCE = (
    "case when code = 'internal_error' then 'api_server' when starts_with(code, 'ollama_') then 'ollama'"
    " when starts_with(code, 'ocr_') or starts_with(code, 'document_extraction') then 'ocr'"
    " when http_status between 400 and 499 then 'client' else 'server' end"
)
_FAILED = f"with e as (select ts, event_type, event_id as seq, cast(user_id as varchar) as request_id, {d.EVENT_CODE} as code, {d.EVENT_STATUS} as http_status, props as detail from events)"
_RETRY = "code <> 'internal_error' and http_status in (429, 502, 503, 504)"

ORACLES["error_classify"] = f"""
{_FAILED}
select seq, request_id, {_SOURCE} as source, code, http_status, {_RETRY} as retryable, detail from e
"""

ORACLES["error_envelopes"] = f"""
{_FAILED}
select false as success, request_id, '{{"code":"' || code || '","detail":"' || replace(detail, '"', chr(92) || '"') || '","source":"' || {_SOURCE}
  || '","retryable":' || case when {_RETRY} then 'true' else 'false' end || '}}' as error
from e
"""

ORACLES["request_errors"] = """
select event_id, case event_id % 3 when 0 then 'The request is invalid'
  when 1 then 'body.items.' || cast(event_id as varchar) || '.text: Field required'
  else 'body.items.' || cast(event_id as varchar) || '.text: Field required; query: ' || props end as detail
from events
"""

ORACLES["recent_errors"] = f"""
{_FAILED}
select seq, {_ISO.format('ts')} as occurred_at, {_SOURCE} as source, code, http_status, {_RETRY} as retryable
from e where event_type = 'error' order by ts desc, seq desc limit 20
"""

ORACLES["stream_error_history"] = f"""
{_FAILED}
select seq, {_SOURCE} as source, code, http_status from e where event_type = 'error' order by ts desc, seq desc limit 100
"""

_NOW = "(select max(ts) from events)"
_OPEN = f"""
with s as (select event_id, user_id, event_type, ts from events where event_id % 2 = 0),
f as (select event_id - 1 as event_id, ts from events where event_id % 2 = 1 and event_type <> 'error'),
o as (
  select s.* from s left join f on f.event_id = s.event_id and f.ts <= {_NOW} where s.ts <= {_NOW} and f.event_id is null
)
"""

ORACLES["open_requests"] = f"""
{_OPEN}
select cast(event_id // 2 as varchar) as token, 'r' || cast(user_id as varchar) as request_id, event_type as operation, 'processing' as phase,
  ((epoch_us({_NOW}) - epoch_us(ts) + 500) // 1000) / 1000.0 as elapsed_seconds
from o
"""

ORACLES["processing_snapshot"] = f"""
{_OPEN}
select count(*) > 0 as is_processing, true as accepting_requests, count(*) as active_count, cast(4 as integer) as max_concurrent,
  greatest(0, 4 - count(*)) as available_slots, (select least(20, count(*)) from events where event_type = 'error') as recent_error_count
from o
"""

ORACLES["slot_occupancy"] = f"""
with s as (select event_id // 2 as pair, ts from events where event_id % 2 = 0),
f as (select event_id // 2 as pair, ts from events where event_id % 2 = 1 and event_type <> 'error'),
m as (select cast(pair as varchar) as token, ts, 'start' as kind, 1 as mark from s
  union all select cast(f.pair as varchar), f.ts, 'end', -1 from f join s on s.pair = f.pair and f.ts >= s.ts),
r as (select *, cast(sum(mark) over (order by ts, mark, token rows unbounded preceding) as bigint) as active_count from m)
select {_ISO.format('ts')} as at, token, kind, active_count, greatest(0, 4 - active_count) as available_slots from r
"""

# Starts without an end leave once the watermark, an hour behind the slower of the two kinds, is past their six hours.
ORACLES["stream_request_joins"] = f"""
with s as (select event_id, user_id, event_type, ts from events where event_id % 2 = 0),
f as (select event_id - 1 as event_id, ts from events where event_id % 2 = 1 and event_type <> 'error'),
w as (select least((select max(ts) from s), (select max(ts) from f)) - interval 1 hour as mark)
select cast(s.event_id // 2 as varchar) as token, 'r' || cast(s.user_id as varchar) as request_id, s.event_type as operation,
  {_ISO.format('s.ts')} as started_at, case when f.ts is not null then {_ISO.format('f.ts')} end as ended_at
from s left join f on f.event_id = s.event_id and f.ts between s.ts and s.ts + interval 6 hours, w
where f.ts is not null or s.ts + interval 6 hours < w.mark
"""

ORACLES["stream_open_requests"] = f"""
select cast(s.event_id // 2 as varchar) as token, 'r' || cast(s.user_id as varchar) as request_id, f.event_id is null as is_open,
  {_ISO.format('s.ts')} as started_at
from events s left join events f on f.event_id = s.event_id + 1 and f.event_type <> 'error'
where s.event_id % 2 = 0
"""

# --- model and whole job -----------------------------------------------------

ORACLES["model_replies"] = f"""
with c as (select doc_id, {compact('text')} as t from documents),
u as (select *, case when doc_id % 2 = 0 then 'uae' else 'usa' end as country from c where length(t) between 20 and 32768),
f as (select *, country = 'usa' and length(t) % 5 = 0 as timed_out from u)
select cast(doc_id as varchar) as doc_key, country, case when not timed_out then substring(t, 1, 20) end as vendor_name,
  cast(case when not timed_out then length(t) end as double) as net_amount, case when not timed_out then length(t) end as output_tokens,
  cast(case when timed_out then 504 end as integer) as status
from f
"""

_JOB = f"""
with p as (
  select *, cast(o_orderkey as varchar) as doc_key, {d.COUNTRY} as country,
    case when o_orderkey % 29 <> 0 then {compact("'--- PAGE 1 ---' || chr(10) || " + d.FIRST_PAGE)}
      || case when o_orderkey % 2 = 0 then '' else chr(10) || '--- PAGE 2 ---' || chr(10) || 'Total ' || {d.PRICE_TEXT} end end as body
  from orders
), c as (
  select *, o_orderkey % 29 = 0 as unread, o_orderkey % 37 = 0 as busy, o_orderkey % 31 = 0 as broken,
    {d.PRICE} as price
  from p
), ok as (select *, not busy and not broken as good from c where not unread)
"""

ORACLES["invoice_extraction"] = _JOB + f"""
select doc_key, country, cast(length(body) as integer) as character_count,
  case when good then 'V' || cast(o_orderkey % 50 as varchar) end as vendor_name,
  case when good then case country when 'uae' then 'INV-' when 'usa' then 'US-' else 'IN-' end || doc_key end as invoice_no,
  cast(case when good then case country when 'uae' then cast({d.UAE_TOTAL} as decimal(15,2)) when 'usa' then price else price + 18 end end as double) as total,
  cast(case when good then case when country = 'usa' then 2 else 1 end end as integer) as n_items,
  case when good then 700 + o_orderkey % 300 end as total_tokens,
  case when good and country = 'uae' then array_to_string(list_filter([
    case when o_orderkey % 5 = 0 then 'subtotal, VAT, and grand_total do not balance' end,
    case when o_orderkey % 4 = 0 then 'vendor_trn_no was not found in extracted_text' end], lambda x: x is not null), '; ') end as warnings,
  cast(case when busy then 502 when broken then 422 end as integer) as status
from ok
"""



def _json_record(schema: RecordSchema, values: dict[str, str]) -> str:
    """JSON text with all fields of a record; those not in ``values`` are null."""
    fields = [f"'\"{name}\":' || " + values.get(name, "'null'") for name in schema.order]
    return "'{' || " + " || ',' || ".join(fields) + " || '}'"


def _json_list(schema: RecordSchema, *rows: dict[str, str]) -> str:
    return "'[' || " + " || ',' || ".join(_json_record(schema, r) for r in rows) + " || ']'"


def _number(x: str) -> str:
    return f"cast(cast({x} as double) as varchar)"


def _quoted(x: str) -> str:
    return f"'\"' || {x} || '\"'"


_VENDOR = _quoted("'V' || cast(o_orderkey % 50 as varchar)")
_ZERO = {n: "'0.0'" for n in ("igst_amount", "discount", "state_cess", "other_charges")}
_DATA = {
    "uae": _json_record(COUNTRIES["uae"], {
        "vendor_name": _VENDOR, "vendor_trn_no": _quoted(d.SELLER_TRN), "invoice_no": _quoted("'INV-' || doc_key"),
        "invoice_date": _quoted("'2026-01-20'"), "net_amount": _number("price"), "total_tax": _number("o_orderkey % 100 + 0.5"),
        "grand_total": _number(f"cast({d.UAE_TOTAL} as decimal(15,2))"), "currency": _quoted("'AED'"),
        "items": _json_list(COUNTRIES["uae"].lists["items"], {"item": _quoted("'a'"), "qty": "'1.0'", "line_total": _number("price")}),
    }),
    "usa": _json_record(COUNTRIES["usa"], {
        "vendor_name": _VENDOR, "invoice_no": _quoted("'US-' || doc_key"), "payable_amount": _number("price"),
        "items": _json_list(COUNTRIES["usa"].lists["items"], {"line_number": _quoted("'1'"), "line_total": _number("price")}, {"line_total": "'2.0'"}),
    }),
    "india": _json_record(COUNTRIES["india"], {
        "vendor_name": _VENDOR, "invoice_number": _quoted("'IN-' || doc_key"), "taxable_amount": _number("price"), "cgst_amount": "'9.0'",
        "sgst_amount": "'9.0'", "invoice_amount": _number("price + 18"), "irn_number": _quoted("'0'"), **_ZERO,
        "items": _json_list(COUNTRIES["india"].lists["items"], {"sr_no": _quoted("'1'"), "amount": _number("price")}),
        "hsn_summary": _json_list(COUNTRIES["india"].lists["hsn_summary"], {"cgst": "'9.0'", "sgst": "'9.0'"}),
    }),
}

_ENVELOPES = f"""
select doc_key, true as success, 'req-' || doc_key as request_id, body as character_stored, country,
  case country when 'uae' then {_DATA['uae']} when 'usa' then {_DATA['usa']} else {_DATA['india']} end as data,
  case when country = 'uae' then '{{"is_valid":' || case when o_orderkey % 5 = 0 or o_orderkey % 4 = 0 then 'false' else 'true' end || ',"warnings":['
    || array_to_string(list_filter([
      case when o_orderkey % 5 = 0 then '"subtotal, VAT, and grand_total do not balance"' end,
      case when o_orderkey % 4 = 0 then '"vendor_trn_no was not found in extracted_text"' end], lambda x: x is not null), ',') || ']}}' end as validation,
  '{{"total_pages":2,"character_count":' || cast(length(body) as varchar) || ',"finish_reason":"stop","model_name":"gemma2:2b","model_provider":"ollama"}}' as metadata,
  '{{"input_tokens":700,"output_tokens":' || cast(o_orderkey % 300 as varchar) || ',"total_tokens":' || cast(700 + o_orderkey % 300 as varchar) || ',"execution_time_ms":5000}}' as token_usage
from ok where good
"""
ORACLES["success_envelopes"] = _JOB + _ENVELOPES

_CALLER = d.INVOICE_ID.replace("doc_id", "o_orderkey")
ORACLES["completion_envelopes"] = _JOB + f"""
, e as ({_ENVELOPES}),
q as (select cast(o_orderkey as varchar) as doc_key, {_CALLER} as raw, {strip(_CALLER)} as invoice_id from orders),
v as (select *, length(raw) between 1 and 100 and length(invoice_id) between 1 and 100 as valid from q)
select e.*, invoice_id, cast(null as varchar) as code from e join v on v.doc_key = e.doc_key where valid
union all by name
select doc_key, 'invalid_invoice_id' as code from v where not valid
"""

ORACLES["extraction_errors"] = _JOB + """
select o_orderkey as seq, 'req-' || doc_key as request_id, case when unread then 'ocr' else 'ollama' end as source,
  case when unread then 'document_extraction_failed' else 'ollama_service_error' end as code,
  cast(case when unread then 422 when busy then 502 else 422 end as integer) as http_status, not unread and busy as retryable
from c where unread or busy or broken
"""
