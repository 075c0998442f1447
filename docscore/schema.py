"""Record types and vocabularies."""

from __future__ import annotations

# fixed values: field names, their groups, and the vocabularies of annotations
BUSINESS_FIELDS = [
    "vendor_name", "business_tax_id", "invoice_number", "invoice_date",
    "amount_before_vat", "vat_amount", "total_amount", "allocation_number",
]
CRITICAL_FIELDS = ["business_tax_id", "invoice_number", "invoice_date", "total_amount"]
AMOUNT_FIELDS = ["amount_before_vat", "vat_amount", "total_amount"]
ID_FIELDS = ["business_tax_id", "invoice_number", "allocation_number"]
CANONICAL_KEYS = [
    "source_file", "vendor_name", "business_tax_id", "business_tax_id_valid", "invoice_number", "invoice_date",
    "amount_before_vat", "vat_amount", "total_amount", "allocation_number", "extraction_notes",
]
STRING_FIELDS = ["source_file", "vendor_name", "business_tax_id", "invoice_number", "invoice_date", "allocation_number"]
PRESENCE_VALUES = ["PRESENT", "ABSENT", "UNREADABLE", "AMBIGUOUS"]
MANIFEST_KEYS = ["document_id", "source_file", "split", "language", "pages"]

# schemas as DDL text
INVOICE = (
    "source_file string, vendor_name string, business_tax_id string, business_tax_id_valid boolean, invoice_number string, "
    "invoice_date string, amount_before_vat double, vat_amount double, total_amount double, allocation_number string, extraction_notes array<string>"
)
REGION = "page int, text string, polygon array<struct<x double, y double>>, granularity string, confidence double, reading_order int"
ANNOTATION = (
    "field_presence map<string,string>, adjudication_status string, seeded_by string, note string, transcription_confidence string, ocr_sample array<string>"
)
MANIFEST = (
    "document_id string, source_file string, split string, language string, pages array<string>, tags array<string>, "
    f"ground_truth struct<{INVOICE}>, annotation struct<{ANNOTATION}>"
)
RESULT = (
    "document_id string, source_file string, split string, language string, engine_id string, engine_metadata map<string,string>, region_count int, "
    f"page_sizes array<array<int>>, assembled_text string, regions array<struct<{REGION}>>, prediction struct<{INVOICE}>, timings_ms map<string,double>, "
    "error struct<label string, message string, traceback string>"
)
WORKER = (
    "worker_version string, pages array<struct<page_index int, width int, height int, regions array<struct<text string, polygon array<array<double>>, "
    "granularity string, confidence string, reading_order int>>>>, timings_ms map<string,double>, error struct<label string, message string>"
)
_BOX = "struct<vertices array<struct<x double, y double>>, normalizedVertices array<struct<x double, y double>>>"
_WORD = f"struct<symbols array<struct<text string>>, confidence double, boundingBox {_BOX}>"
CLOUD = f"pages array<struct<width int, height int, blocks array<struct<paragraphs array<struct<words array<{_WORD}>>>>>>>"
