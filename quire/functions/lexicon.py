"""Word lists, labels and patterns that fix which documents and fields are recognised."""

TYPE_KEYWORDS = {
    "contract": ["hop dong", "contract", "ben a", "ben b", "dieu khoan", "hieu luc", "thoi han", "ky ten"],
    "receipt": ["bien lai", "receipt", "phieu thu", "da thanh toan", "payment", "cashier"],
    "warehouse_note": ["phieu nhap", "phieu xuat", "kho", "hang hoa", "so luong", "don vi tinh"],
    "form": ["cong hoa", "doc lap", "don de nghi", "to khai", "mau so", "so cmnd", "cccd"],
}
STRONG_INVOICE = [
    r"\binvoice\s*#(?=\s|$)", r"\binvoice\s*(?:no|number|date)\b", r"\b(?:bill|billed|billing)\s+to\b", r"\bship\s+to\b", r"\bamount\s+due\b", r"\bbalance\s+due\b",
    r"\bsub\s*total\b", r"\btax\s+rate\b", r"\btax\s+code\b", r"\bhoa don\s*(?:so)?\b", r"\bso hoa don\b", r"\bmau so\b", r"\bky hieu\b", r"\bma so thue\b", r"\bmst\b",
    r"\bdon vi ban hang\b", r"\bnguoi mua hang\b", r"\btong cong tien thanh toan\b",
]
MEDIUM_INVOICE = [r"\binvoice\b", r"\bvat\b", r"\bsubtotal\b", r"\btotal\b", r"\bamount\b", r"\bpayment method\b", r"\bseller\b", r"\bbuyer\b", r"\bnguoi ban\b", r"\bnguoi mua\b", r"\btong tien\b", r"\bthanh tien\b"]
REFERENCE_LISTS = [r"\binvoices\b", r"\breceipts\b", r"\bbank statements\b", r"\bpassport documents\b", r"\bdata records\b"]
#: Rounded confidences by score; a higher score takes the last.
INVOICE_CONFIDENCE = {4: 0.80, 5: 0.85, 6: 0.91, 7: 0.94}
TYPE_CONFIDENCE = {1: 0.56, 2: 0.61, 3: 0.65, 4: 0.68, 5: 0.70, 6: 0.72, 7: 0.74, 8: 0.76}
TOTAL_CONFIDENCE = {1: 0.78, 2: 0.84, 3: 0.90, 4: 0.92}
TOTAL_WORDS = ["tong cong", "tong cong tien thanh toan", "tong tien thanh toan", "tong tien", "cong tien hang", "thanh toan", "amount due", "grand total", "total"]

DATE = r"\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}[/-]\d{1,2}[/-]\d{1,2})\b"
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
PHONE = r"(?<!\d)(?:\+?84|0)(?:[\s.\-]?\d){8,10}(?!\d)"
AMOUNT = r"(?iu)(?:(?:VND|VNĐ|USD|\$)\s*)?-?\d{1,3}(?:[.,\s]\d{3})+(?:[.,]\d{1,2})?|(?:-?\d+(?:[.,]\d{1,2})?\s*(?:VND|VNĐ|USD|\$|đ))"
TAX_CODE = r"\b\d{10}(?:[-\s]?\d{3})?\b"
TAX_WORDS = ["mst", "ma so thue", "tax code", "tax id"]
INVOICE_NUMBER = [r"(?i)(?:so hoa don|hoa don so|so hd|so|no|number|invoice)\s*[:#\-]?\s*([A-Z0-9][A-Z0-9\-/.]{2,})", r"(?i)(?:hoa don|invoice).*?([A-Z0-9]{2,}[-/.]?\d{2,})"]
INVOICE_NUMBER_LINES = ["hoa don", "invoice", "so", "no", "so hd"]
MONTHS = "jan|january|feb|february|mar|march|apr|april|may|jun|june|jul|july|aug|august|sep|sept|september|oct|october|nov|november|dec|december"

PARTY_LABELS = {
    "party_a": ["ben a", "party a"],
    "party_b": ["ben b", "party b"],
    "seller": ["nguoi ban", "seller", "vendor", "from", "don vi ban", "don vi ban hang", "ben ban"],
    "buyer": ["nguoi mua", "buyer", "customer", "client", "bill to", "billed to", "billing to", "don vi mua", "nguoi mua hang", "khach hang", "ben mua"],
}
#: field: (labels, confidence, source)
LOCAL_LABELS = {
    "invoice_form": (["mau so", "form"], 0.74, "line:mau_so"),
    "invoice_symbol": (["ky hieu", "serial"], 0.74, "line:ky_hieu"),
    "payment_method": (["hinh thuc thanh toan", "payment method"], 0.68, "line:hinh_thuc_thanh_toan"),
    "amount_in_words": (["so tien viet bang chu", "bang chu", "amount in words"], 0.66, "line:so_tien_bang_chu"),
    "seller_address": (["dia chi nguoi ban", "dia chi ben ban"], 0.62, "line:dia_chi_nguoi_ban"),
    "buyer_address": (["dia chi nguoi mua", "dia chi ben mua"], 0.62, "line:dia_chi_nguoi_mua"),
    "invoice_number": (["so hoa don", "hoa don so", "so hd"], 0.74, "line:so_hoa_don"),
    "seller": (["don vi ban hang", "ten nguoi ban", "nguoi ban", "ben ban", "seller", "vendor", "from"], 0.70, "line:nguoi_ban"),
    "buyer": (["ho ten nguoi mua hang", "nguoi mua hang", "ten nguoi mua", "nguoi mua", "ben mua", "bill to", "billed to", "billing to", "customer", "client"], 0.70, "line:nguoi_mua"),
}
NEXT_LINE_STOPS = ["mau so", "ky hieu", "so hoa don", "ngay", "ma so thue", "mst", "nguoi mua", "nguoi ban", "don vi mua", "don vi ban", "dia chi", "hinh thuc thanh toan", "tong cong", "tong tien", "cong tien hang"]
INVOICE_ONLY = ["invoice_number", "invoice_form", "invoice_symbol", "tax_codes", "amount_in_words", "ma_so_thue", "mst", "so_hoa_don", "hoa_don_so", "mau_so", "ky_hieu", "so_tien_bang_chu"]
FINANCIAL = ["total_amount", "payment_method", "tong_tien", "tong_cong", "tong_thanh_toan", "amount_due", "balance_due", "hinh_thuc_thanh_toan", "phuong_thuc_thanh_toan"]
REQUIRED = {"invoice": ["invoice_number", "total_amount"], "receipt": ["total_amount"], "contract": ["primary_date"]}
SUMMARY_LABELS = {
    "invoice": "Tài liệu có dấu hiệu là hóa đơn",
    "contract": "Tài liệu có dấu hiệu là hợp đồng",
    "receipt": "Tài liệu có dấu hiệu là biên lai/phiếu thu",
    "warehouse_note": "Tài liệu có dấu hiệu là phiếu kho",
    "form": "Tài liệu có dấu hiệu là biểu mẫu hành chính",
    "general_document": "Tài liệu văn bản tổng quát",
}
MODEL_LABEL_VALUES = ["date", "invoice", "invoice date", "due date", "invoice due date", "invoice #", "invoice no", "invoice number", "bill to", "ship to", "seller", "buyer", "address", "total", "subtotal", "sub total", "amount", "amount due", "balance due", "tax", "rate", "qty"]
PARTY_FIELDS = ["seller", "buyer", "seller_address", "buyer_address", "shipping_address", "billing_address"]
ENTITY_FIELDS = {"COMPANY": "seller", "ADDRESS": "seller_address", "DATE": "primary_date", "TOTAL": "total_amount"}
LABEL_MARKERS = ["invoice", "invoice #", "invoice no", "invoice number", "date", "due", "terms", "total", "amount", "qty", "rate", "bill to", "ship to", "payment method"]

SECTION_ALIASES = {
    "buyer": ["bill to", "billed to", "billing to", "sold to", "buyer", "customer", "client", "nguoi mua", "nguoi mua hang", "ben mua", "khach hang", "don vi mua"],
    "seller": ["seller", "vendor", "from", "supplier", "nguoi ban", "ben ban", "don vi ban", "don vi ban hang"],
    "shipping_address": ["ship to", "shipping to", "deliver to", "delivery address", "giao den", "dia chi giao hang"],
    "billing_address": ["billing address", "bill address", "dia chi thanh toan"],
}
FIELD_ALIASES = {
    "invoice_number": ["invoice#", "invoice #", "invoice no", "invoice number", "so hoa don", "hoa don so", "so hd"],
    "invoice_form": ["mau so", "form"],
    "invoice_symbol": ["ky hieu", "serial"],
    "payment_method": ["payment method", "hinh thuc thanh toan", "phuong thuc thanh toan"],
}
STOP_LABELS = [
    "ship to", "shipping to", "bill to", "billed to", "billing to", "sold to", "invoice", "invoice #", "invoice number", "invoice#", "invoice no", "date", "invoice date", "terms", "due date",
    "payment method", "reference code", "prepared by", "approved by", "item", "item & description", "description", "qty", "rate", "amount", "total", "sub total", "subtotal", "tax", "balance due",
    "mau so", "ky hieu", "so hoa don", "ma so thue", "mst", "nguoi mua", "nguoi ban", "dia chi", "tong cong", "tong tien",
]
LABEL_HINTS = [
    "code", "number", "no", "date", "terms", "due", "by", "method", "status", "reference", "prepared", "approved", "contact", "email", "phone", "tax", "total", "balance", "amount", "invoice",
    "payment", "address", "ma", "so", "ngay", "mau", "ky", "hieu", "thue", "thanh", "toan",
]
TABLE_MARKERS = ["item", "description", "qty", "rate", "amount", "stt", "so luong", "don gia", "thanh tien"]
FIELD_CANONICALS = {
    "buyer": ["buyer"], "seller": ["seller"], "shipping_address": ["shipping_address"], "buyer_address": ["buyer", "billing_address"], "seller_address": ["seller"],
    "payment_method": ["payment_method"], "invoice_number": ["invoice_number"], "invoice_form": ["invoice_form"], "invoice_symbol": ["invoice_symbol"],
}

HEADERS = {
    "#": ["#", "no", "no.", "stt", "id"],
    "Item & Description": ["item", "description", "desc", "product", "service", "hang hoa", "ten hang", "hang hoa dich vu", "ten hang hoa dich vu", "noi dung"],
    "Unit": ["unit", "dvt", "don vi tinh", "don vi"],
    "Qty": ["qty", "quantity", "sl", "so luong"],
    "Rate": ["rate", "price", "unit price", "don gia"],
    "Amount": ["amount", "total", "thanh tien", "money", "tien hang"],
}
LOCAL_HEADERS = {"#": "STT", "Item & Description": "Tên hàng hóa, dịch vụ", "Unit": "ĐVT", "Qty": "Số lượng", "Rate": "Đơn giá", "Amount": "Thành tiền"}
LOCAL_HEADER_MARKERS = ["stt", "ten hang", "hang hoa", "dvt", "don vi tinh", "so luong", "don gia", "thanh tien"]
STOP_ROWS = ["sub total", "subtotal", "cong tien hang", "tong cong", "tong cong tien thanh toan", "tong tien", "tien thue", "gtgt", "tax", "vat", "balance", "grand total"]

LAYOUT_TABLE = ["#", "item", "description", "qty", "quantity", "stt", "ten hang", "hang hoa", "hang hoa dich vu", "dvt", "don vi tinh", "so luong", "don gia", "rate", "amount", "price", "thanh tien", "so luong", "don gia"]
LAYOUT_TOTAL = ["sub total", "subtotal", "cong tien hang", "total", "grand total", "tong cong tien thanh toan", "balance", "amount due", "tong cong", "tong tien", "tien thue", "gtgt", "thanh toan"]
LAYOUT_INFO = [
    "invoice", "hoa don", "receipt", "bien lai", "date", "ngay", "mst", "ma so thue", "tax", "mau so", "ky hieu", "so hoa don", "hoa don so", "hinh thuc thanh toan", "tai khoan", "email", "phone",
    "dien thoai", "sdt", "address", "dia chi", "buyer", "seller", "nguoi mua", "nguoi ban",
]
LAYOUT_SIGNATURE = ["signature", "signed", "authorized", "ky ten", "chu ky", "nguoi lap", "nguoi nhan", "nguoi giao"]
LAYOUT_FOOTER = ["thank", "cam on", "terms", "conditions", "footer", "page", "trang"]
LAYOUT_TITLE = ["invoice", "hoa don", "receipt", "bien lai"]
REGION_LABELS = {
    "table": "Danh sách sản phẩm", "dense_table": "Bảng dữ liệu", "title": "Tiêu đề tài liệu", "header": "Vùng đầu trang", "important_info": "Vùng thông tin quan trọng", "total": "Vùng tổng tiền",
    "signature": "Vùng chữ ký", "left_column": "Cột trái", "right_column": "Cột phải", "paragraph": "Đoạn văn", "footer": "Vùng chân trang",
}

#: (words of the question, field), in order.
QUESTION_FIELDS = [
    (["hinh thuc thanh toan", "phuong thuc thanh toan", "payment method", "thanh toan bang gi"], "payment_method"),
    (["tong", "total", "thanh tien", "amount", "bao nhieu tien"], "total_amount"),
    (["ngay", "date", "ngay ky", "ngay lap", "ngay mua"], "primary_date"),
    (["hoa don", "invoice", "so hoa don"], "invoice_number"),
    (["ma so thue", "mst", "tax"], "tax_codes"),
    (["email"], "emails"),
    (["dien thoai", "phone", "sdt"], "phone_numbers"),
    (["ben a", "party a"], "party_a"),
    (["ben b", "party b"], "party_b"),
    (["nguoi ban", "ben ban", "don vi ban", "seller"], "seller"),
    (["nguoi mua", "ben mua", "don vi mua", "buyer", "ai la ben mua"], "buyer"),
    (["mau so"], "invoice_form"),
    (["ky hieu"], "invoice_symbol"),
    (["so tien bang chu", "bang chu"], "amount_in_words"),
]
ANSWER_LABELS = {
    "buyer": ["ho ten nguoi mua hang", "nguoi mua hang", "ten nguoi mua", "nguoi mua", "don vi mua", "ten don vi mua", "khach hang", "bill to", "billed to", "billing to", "customer", "client", "ben mua"],
    "seller": ["don vi ban hang", "ten nguoi ban", "nguoi ban", "ten don vi ban", "ben ban", "seller", "vendor", "from"],
    "payment_method": ["hinh thuc thanh toan", "phuong thuc thanh toan", "payment method"],
    "invoice_number": ["so hoa don", "hoa don so", "so hd"],
    "invoice_form": ["mau so"],
    "invoice_symbol": ["ky hieu"],
    "amount_in_words": ["so tien viet bang chu", "bang chu"],
}
#: Fields that an answer without a canonical label may still fill.
LOOSE_FIELDS = ["total_amount", "primary_date", "tax_codes", "emails", "phone_numbers", "amount_in_words"]
SUMMARY_QUESTIONS = ["tom tat", "tom luoc", "summary", "noi dung chinh", "noi dung", "noi ve"]
NO_ANSWER = "Chưa tìm thấy câu trả lời rõ ràng trong tài liệu OCR."
VOCABULARY = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÈÉÊÌÍÒÓÔÕÙÚÝàáâãèéêìíòóôõùúýĂăĐđĨĩŨũƠơƯưẠạẢảẤấẦầẨẩẪẫẬậẮắẰằẲẳẴẵẶặẸẹẺẻẼẽẾếỀềỂểỄễỆệỈỉỊịỌọỎỏỐốỒồỔổỖỗỘộỚớỜờỞởỠỡỢợỤụỦủỨứỪừỬửỮữỰựỲỳỴỵỶỷỸỹ!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~° "
