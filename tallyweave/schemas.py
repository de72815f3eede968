"""Row types, closed domains and default policy of the invoice jobs."""

RAW_LINE = "struct<description:string,quantity_raw:string,unit:string,unit_price_raw:string,amount_raw:string,tax_rate_raw:string>"
RAW_TAX = "struct<rate_raw:string,base_raw:string,tax_raw:string>"
RAW_MARK = "struct<text:string,location:string,affects_payment_details:boolean>"
CONFIDENCES = ("supplier_name", "supplier_registration_no", "invoice_number", "issue_date", "due_date", "subtotal", "tax_amount", "total_amount", "lines")
RAW_TEXTS = ("supplier_name", "supplier_registration_no", "invoice_number", "issue_date_raw", "due_date_raw", "subtotal_raw", "tax_amount_raw", "total_amount_raw", "currency", "bank_details_raw", "notes")
RAW_SCHEMA = (
    ", ".join(f"{c} string" for c in RAW_TEXTS)
    + f", lines array<{RAW_LINE}>, tax_breakdown array<{RAW_TAX}>, handwritten_annotations array<{RAW_MARK}>, field_confidence struct<{','.join(f'{c}:double' for c in CONFIDENCES)}>"
)
LINE = "struct<seq:int,description:string,quantity:bigint,unit:string,unit_price:bigint,amount:bigint,tax_code:string>"
CHECK = "struct<name:string,severity:string,passed:boolean,message:string,detail:string>"

# States, severities, match methods, tax codes, policy defaults.
STATUSES = ("PENDING", "EXTRACTED", "EXTRACT_FAILED", "NEEDS_REVIEW", "BLOCKED", "POSTED", "POST_FAILED", "REJECTED")
ACTIVE = ("POSTED", "NEEDS_REVIEW", "BLOCKED", "EXTRACTED", "POST_FAILED")
REVERIFIABLE = ("EXTRACTED", "NEEDS_REVIEW", "BLOCKED")
SEVERITIES = ("BLOCKER", "ERROR", "WARN", "INFO")
TAX_RATES = {"T10": 0.1, "T08": 0.08}
POLICY = {"amount_review_threshold": 1_000_000, "confidence_floor": 0.80, "duplicate_window_days": 7, "auto_post_enabled": True}
FUZZY_THRESHOLD = 85
FALLBACK_UNIT = "式"
