"""Everything that depends on the kind of documents read: words, patterns, thresholds.

Operators take these as arguments, so the same operator runs on other documents by
passing another profile.  ``Profile()`` is the Thai expense-receipt profile.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --------------------------------------------------------------------------- fixed values
# The word lists, patterns and thresholds below must equal the published ones for results to
# match; they are stated plainly and in their natural order.

CERTIFICATE_MARKERS = ("หนังสือรับรองการหักภาษี", "ผู้ถูกหักภาษี", "50 ทวิ", "ผู้มีหน้าที่หักภาษี")
CERTIFICATE_FORM_LABELS = ("ผู้ถูกหักภาษี", "ผู้มีหน้าที่หักภาษี", "หนังสือรับรอง", "ผู้จ่ายเงิน")
CARD_MARKERS = (
    "บัตรประจำตัวประชาชน", "Thai National ID Card", "วันออกบัตร", "วันหมดอายุ",
    "Date of Issue", "Date of Expiry", "เจ้าหน้าที่ออกบัตร", "ศาสนา",
)
CARD_NAME_LABEL = r"(?:ชื่อตัวและชื่อสกุล|ชื่อ-นามสกุล|ชื่อ–นามสกุล)\s*[:：]?\s*(.+)"
SLIP_MARKERS = ("เลขที่รายการ", "สแกนตรวจสอบสลิป", "บันทึกช่วยจำ", "สำเร็จ")
BANK_MARKERS = (
    "ธ.กสิกรไทย", "ธนาคารกสิกรไทย", "K PLUS", "K+", "ธ.ไทยพาณิชย์", "ธนาคารไทยพาณิชย์", "SCB",
    "ธ.กรุงไทย", "ธนาคารกรุงไทย", "ธ.กรุงเทพ", "ธนาคารกรุงเทพ", "ธ.กรุงศรี",
    "ธนาคารกรุงศรีอยุธยา", "ธ.ทหารไทยธนชาต", "ttb", "ธนาคารออมสิน", "พร้อมเพย์", "PromptPay",
)
SLIP_AMOUNT = r"จำนวน(?:เงิน)?\s*[:：]?\s*([0-9,]+\.[0-9]{2})"
SLIP_FEE = r"ค่าธรรมเนียม\s*[:：]?\s*([0-9,]+\.[0-9]{2})"
SLIP_REFERENCE = r"เลขที่รายการ\s*[:：]?\s*([A-Za-z0-9]{6,})"
TOLL_MARKERS = (
    "ใบรับค่าผ่านทางพิเศษ", "ใบรับค่าธรรมเนียมผ่านทางหลวงพิเศษ", "การทางพิเศษแห่งประเทศไทย",
    "กรมทางหลวง", "TOLLFARE", "EXAT", "ทางด่วนและรถไฟฟ้ากรุงเทพ",
)
TOLL_ISSUER_ID = "0994000165421"
TICKET_REF_FLAT = r"Receipt\s+Running\s+No\s*[:：]?\s*([0-9]{6,})"
TICKET_REF_TABLE = r"<td>\s*No\.?\s*</td>\s*<td>\s*([0-9]{6,})\s*</td>"
TICKET_AMOUNT_FLAT = r"Baht\s*\(\s*(Vat Included|Non Vat)\s*\)\s*([0-9,]+\.[0-9]{2})"
TICKET_AMOUNT_TABLE = (
    r"<td>\s*Baht\s*\(\s*(Vat Included|Non Vat)\s*\)\s*</td>\s*"
    r"<td>\s*([0-9,]+\.[0-9]{2})\s*(?:บาท|Baht|THB)?\s*</td>"
)
TICKET_DATE_FLAT = r"Date\s*Time\s*([0-9]{2})/([0-9]{2})/([0-9]{4})"
TICKET_DATE_TABLE = r"<td>\s*Date\s*Time\s*</td>\s*<td>\s*([0-9]{2})/([0-9]{2})/([0-9]{4})"
PAGE_MARKER = r"(?i)(?:หน้า(?:ที่)?|page)\s*([0-9]{1,2})\s*(?:/|of|จาก)\s*([0-9]{1,2})"
BRANCH_SUFFIX = r"(?:[(\s]*(?:สำนักงานใหญ่|สาขาที่\s*[0-9]+|สาขา\s*[0-9]+)[)\s]*)+$"
NUMBER_LABEL = (
    r"(?i)(เลขที่ใบกำกับภาษี|เลขที่ใบกำกับ|เลขที่|Receipt\s+Running\s+No|BILL\s+NO|No|NO|#)[\s:.]*$"
)
BOOK_LABEL = r"(?i)(เล่มที่|BOOK\s*NO)[\s:.]*$"
HEADING_ROLES = (
    ("ใบเสร็จรับเงิน", "receipt"), ("ใบรับเงิน", "receipt"), ("ใบรับค่าผ่านทางพิเศษ", "receipt"),
    ("ใบกำกับภาษี", "tax_invoice"), ("บิลเงินสด", "cash_bill"),
)
ENGLISH_CASH_HEADINGS = ("CASH SALE", "CASH SALES")
OUTRANKS_ENGLISH_CASH = ("ใบเสร็จรับเงิน", "ใบกำกับภาษี")
CITATION_FORMS = r"(?:เลขที่|เลขที|อ้างอิง|ตาม|หมายเลข)\s*ใบกำกับ(?:ภาษี)?"
PERSON_PREFIXES = ("นาย", "นาง", "นางสาว", "น.ส.", "ด.ช.", "ด.ญ.", "MR.", "MRS.", "MS.")
COMPANY_MARKERS = (
    "บริษัท", "บจก", "หจก", "ห้างหุ้นส่วน", "บมจ", "จำกัด", "มหาชน",
    "CO.,LTD", "CO., LTD", "COMPANY LIMITED", "PUBLIC COMPANY", "PTE",
)
STATE_PREFIXES = (
    "กรม", "กระทรวง", "องค์การ", "เทศบาล", "มหาวิทยาลัย", "โรงเรียน", "โรงพยาบาล",
    "การทางพิเศษ", "การไฟฟ้า", "การประปา", "การรถไฟ", "การท่าเรือ",
    "ธนาคารแห่งประเทศไทย", "สำนักงานเขต",
    "DEPARTMENT OF", "MINISTRY OF", "EXPRESSWAY AUTHORITY",
)
ACCOUNT_LIKE = r"[0-9Xx*•]{4,}"
AMOUNT = r"[0-9]{1,3}(?:,[0-9]{3})*\.[0-9]{2}"
LEGAL_RATE_PERCENTS = (1.0, 1.5, 2.0, 3.0, 5.0, 10.0, 15.0)
WITHHOLDING_RATES = (0.01, 0.015, 0.02, 0.03, 0.05, 0.10, 0.15)
VAT_RATE = 0.07
CALIBRATION_BANDS = ((0.0, 0.5), (0.5, 0.8), (0.8, 0.95), (0.95, 1.01))
EVIDENCE_ROLES = (
    "receipt", "tax_invoice", "cash_bill", "id_document", "transfer_slip",
    "exchange_rate_evidence", "approval_document", "other",
)
CERTIFICATE_ROLE = "withholding_certificate"
# --------------------------------------------------------------------------- end of fixed values


@dataclass(frozen=True)
class CheckScheme:
    """Weighted check digit: the last digit must equal ``(modulus - sum % modulus) % 10``."""

    weights: tuple[int, ...] = tuple(range(13, 1, -1))
    modulus: int = 11
    fold_products: bool = False  # add the digits of each product (Luhn) instead of the product

    @property
    def length(self) -> int:
        return len(self.weights) + 1


MOD11_13 = CheckScheme()
LUHN_16 = CheckScheme(weights=(2, 1) * 7 + (2,), modulus=10, fold_products=True)


@dataclass(frozen=True)
class OwnParty:
    """How our own company shows up on a page.  Empty by default: nothing is recognised as ours."""

    name: str | None = None
    address: str | None = None
    tax_id: str | None = None
    branch: str | None = None
    name_markers: tuple[str, ...] = ()
    address_markers: tuple[str, ...] = ()
    evidence: tuple[str, ...] = ()


@dataclass(frozen=True)
class Thresholds:
    min_chars: int = 80
    max_at_signs: int = 10
    min_segment_chars: int = 8
    min_segments: int = 12
    max_repeat_ratio: float = 0.35
    max_compression: float = 0.12
    certificate_hits: int = 2
    card_hits: int = 2
    slip_hits: int = 2
    toll_hits: int = 1
    name_prefix_chars: int = 8
    name_same: float = 0.90
    name_different: float = 0.60
    certificate_money: float = 0.01
    slip_money: float = 0.05
    label_window: int = 60
    max_marker_pages: int = 20


@dataclass(frozen=True)
class Profile:
    own: OwnParty = field(default_factory=OwnParty)
    limits: Thresholds = field(default_factory=Thresholds)
    id_scheme: CheckScheme = MOD11_13
    certificate_markers: tuple[str, ...] = CERTIFICATE_MARKERS
    certificate_form_labels: tuple[str, ...] = CERTIFICATE_FORM_LABELS
    card_markers: tuple[str, ...] = CARD_MARKERS
    card_name_label: str = CARD_NAME_LABEL
    slip_markers: tuple[str, ...] = SLIP_MARKERS
    bank_markers: tuple[str, ...] = BANK_MARKERS
    slip_amount: str = SLIP_AMOUNT
    slip_fee: str = SLIP_FEE
    slip_reference: str = SLIP_REFERENCE
    toll_markers: tuple[str, ...] = TOLL_MARKERS
    toll_issuer_id: str | None = TOLL_ISSUER_ID
    ticket_refs: tuple[str, ...] = (TICKET_REF_FLAT, TICKET_REF_TABLE)
    ticket_amounts: tuple[str, ...] = (TICKET_AMOUNT_FLAT, TICKET_AMOUNT_TABLE)
    ticket_dates: tuple[str, ...] = (TICKET_DATE_FLAT, TICKET_DATE_TABLE)
    vat_included: str = "vat included"
    page_marker: str = PAGE_MARKER
    branch_suffix: str = BRANCH_SUFFIX
    number_label: str = NUMBER_LABEL
    book_label: str = BOOK_LABEL
    heading_roles: tuple[tuple[str, str], ...] = HEADING_ROLES
    cash_headings: tuple[str, ...] = ENGLISH_CASH_HEADINGS
    cash_outranked_by: tuple[str, ...] = OUTRANKS_ENGLISH_CASH
    cash_role: str = "cash_bill"
    citation_forms: str = CITATION_FORMS
    person_prefixes: tuple[str, ...] = PERSON_PREFIXES
    company_markers: tuple[str, ...] = COMPANY_MARKERS
    state_prefixes: tuple[str, ...] = STATE_PREFIXES
    amount: str = AMOUNT
    legal_rate_percents: tuple[float, ...] = LEGAL_RATE_PERCENTS
    withholding_rates: tuple[float, ...] = WITHHOLDING_RATES
    vat_rate: float = VAT_RATE
    declared_roles: tuple[str, ...] = EVIDENCE_ROLES
