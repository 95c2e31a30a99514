"""Word lists, label patterns and dictionaries of identity-card records. All of them are fixed values."""

from __future__ import annotations

# ---- fixed values: fields in record order
FIELDS = ("idNumber", "fullName", "dateOfBirth", "gender", "nationality", "placeOfOrigin", "placeOfResidence", "dateOfExpiry")
SOURCES = ("RAW_TEXT_RECOVERY", "FULL_CARD_OCR", "FIELD_OCR")
COUNTRY, FEMALE, MALE = "Việt Nam", "Nữ", "Nam"

# ---- fixed values: phrase patterns, matched without accents and case, and what they become
PHRASES = (
    (r"\bhova\s*ten\b", "Ho va ten"), (r"\bhovaten\b", "Ho va ten"), (r"\bho\s*va\s*ten\b", "Ho va ten"),
    (r"\bngaysinh\b", "Ngay sinh"), (r"\bngay\s*sinh\b", "Ngay sinh"),
    (r"\bgioitinh\b", "Gioi tinh"), (r"\bgioi\s*tinh\b", "Gioi tinh"),
    (r"\bquoctich\b", "Quoc tich"), (r"\bquoc\s*tich\b", "Quoc tich"),
    (r"\bquequan\b", "Que quan"), (r"\bque\s*quan\b", "Que quan"),
    (r"\bnoithuongtru\b", "Noi thuong tru"), (r"\bn[o0](?:i|[1l])?\s*thu[o0]ng\s*tr?u\b", "Noi thuong tru"),
    (r"\bnoi\s*thuong\s*tru\b", "Noi thuong tru"), (r"\bnoi\s*thuong\s*tu\b", "Noi thuong tru"),
    (r"\bcancuoccongdan\b", "CAN CUOC CONG DAN"), (r"\bcan\s*cuoc\s*conc\s*dan\b", "CAN CUOC CONG DAN"),
    (r"\bfullname\b", "Full name"),
    (r"\bdateofbirth\b", "Date of birth"), (r"\bdate\s*ofbirth\b", "Date of birth"), (r"\bdateof\s*birth\b", "Date of birth"),
    (r"\bplaceoforigin\b", "Place of origin"), (r"\bplace\s*oforigin\b", "Place of origin"), (r"\bplaceof\s*origin\b", "Place of origin"),
    (r"\bplace\s*o[fl]\s*o(?:ri|r|n|ni|i)?g(?:i)?n", "Place of origin "),
    (r"\bplaceofresidence\b", "Place of residence"), (r"\bplace\s*ofresidence\b", "Place of residence"), (r"\bplaceof\s*residence\b", "Place of residence"),
    (r"\bplace\s*o[fl]\s*['\"]?\s*resid[eaou]nce", "Place of residence "),
    (r"\bdateofexpiry\b", "Date of Expiry"), (r"\bdate\s*ofd[a-z]*piry\b", "Date of Expiry"), (r"\bdate\s*of\s*[dexp]{1,3}piry\b", "Date of Expiry"),
    (r"\bcitizenidentitycard\b", "Citizen Identity Card"),
    (r"\bvict\s*nana\b", "Việt Nam"), (r"\bviet\s*nana\b", "Việt Nam"), (r"\bvict\s*nam\b", "Việt Nam"), (r"\bvietnam\b", "Việt Nam"),
    (r"\bfreedom\s*happiness\b", "Freedom - Happiness"), (r"\bindependence\s*freedom\b", "Independence - Freedom"),
)

# ---- fixed values: place phrases without accents and their spelling, longer ones first
PLACES = (
    (r"\bthua\s+thien\s+hue\b", "Thừa Thiên Huế"), (r"\bthanh\s+pho\s+thanh\s+hoa\b", "Thành phố Thanh Hóa"), (r"\bthi\s+tran\s+voi\b", "Thị trấn Vôi"), (r"\bphu\s+van\s+nam\b", "Phú Vân Nam"),
    (r"\bbach\s+thuan\b", "Bách Thuận"), (r"\bvu\s+thu\b", "Vũ Thư"), (r"\bthai\s+binh\b", "Thái Bình"), (r"\bhai\s+chau\b", "Hải Châu"), (r"\bhai\s+hau\b", "Hải Hậu"), (r"\bnam\s+dinh\b", "Nam Định"),
    (r"\bdong\s+son\b", "Đông Sơn"), (r"\bnguyen\s+hong\b", "Nguyên Hồng"), (r"\btan\s+son\b", "Tân Sơn"), (r"\bthanh\s+hoa\b", "Thanh Hóa"), (r"\bea\s+hiao\b", "Ea Hiao"), (r"\bea\s+h\s*['’]?\s*leo\b", "Ea H'Leo"),
    (r"\bdak\s+lak\b", "Đắk Lắk"), (r"\ble\s+loi\b", "Lê Lợi"), (r"\bpho\s+voi\b", "Phố Vôi"), (r"\blang\s+giang\b", "Lạng Giang"), (r"\bbac\s+giang\b", "Bắc Giang"), (r"\bvinh\s+ha\b", "Vinh Hà"),
    (r"\bphu\s+vang\b", "Phú Vang"), (r"\bphu\s+tuyen\b", "Phú Tuyên"), (r"\bbinh\s+thanh\b", "Bình Thành"), (r"\bhuong\s+tra\b", "Hương Trà"), (r"\bthanh\s+pho\b", "Thành phố"), (r"\bthi\s+tran\b", "Thị trấn"),
)

# ---- fixed values: names
DISPUTED_SURNAMES = {"HO": "HỒ"}
SURNAMES = {
    "NGUYEN": "NGUYỄN", "TRAN": "TRẦN", "LE": "LÊ", "PHAM": "PHẠM", "HOANG": "HOÀNG", "HUYNH": "HUỲNH", "PHAN": "PHAN", "VU": "VŨ", "VO": "VÕ", "DANG": "ĐẶNG", "BUI": "BÙI",
    "DO": "ĐỖ", "HO": "HỒ", "NGO": "NGÔ", "DUONG": "DƯƠNG", "LY": "LÝ", "TRUONG": "TRƯƠNG", "DINH": "ĐINH", "TRINH": "TRỊNH", "DAO": "ĐÀO", "LUU": "LƯU", "TA": "TẠ",
}
FEMALE_NAMES = {"THI": "THỊ", "MAY": "MÂY", "HUYEN": "HUYỀN"}
MALE_NAMES = {"VAN": "VĂN", "TUNG": "TÙNG"}
NOT_NAMES = ("VA", "TEN", "FULL", "NAME", "NO", "SO", "IDENTITY", "CARD", "CITIZEN", "NGAY", "SINH", "DATE", "OF", "BIRTH", "GIOI", "TINH", "SEX", "QUOC", "TICH", "NATIONALITY")
NOT_NAMES_LINE = ("HO", "VA", "TEN", "FULL", "NAME", "NGAY", "SINH", "DATE", "BIRTH", "GIOI", "TINH", "SEX", "QUOC", "TICH", "NATIONALITY", "CITIZEN", "IDENTITY", "CARD")
NOT_HEADINGS = ("CONG HOA", "SOCIALIST", "INDEPENDENCE", "FREEDOM", "HAPPINESS", "CAN CUOC", "CITIZEN", "FULL NAME", "DATE OF BIRTH", "PLACE OF", "RESIDENCE", "EXPIRY")

# ---- fixed values: category words
FEMALE_WORDS = ("nu", "female", "ni", "nw", "nv", "nii", "nuu")
MALE_WORDS = ("nam", "male")
FEMALE_WORDS_LINE = ("nu", "nữ", "ni", "nv", "nw", "female")

# ---- fixed values: readings of the country's name
COUNTRY_LINE = r"\bviet\s*nam\b"
COUNTRY_LABEL = r"\b(?:viet\s*nam|vict\s*nam|vict\s*nana)\b"
COUNTRY_FIELD = r"\b(?:vi[ec]t\s*nam|viet\s*nana|vict\s*nana|vietnam)\b"
COUNTRY_FUSION, COUNTRY_LEGACY = "vietna[mn]", "VIET|VICT|NANA"
COUNTRY_LAYOUT, COUNTRY_SHORT = ("vietnam", "vietnan", "vietnarn", "victnam"), ("vn", "vnm")

# ---- fixed values: label patterns, matched without case
ORIGIN_EN = r"place\s*o[fl]\s*o(?:ri|r|n|ni|i)?g(?:i)?n"
RESIDENCE_EN = r"place\s*o[fl]\s*['\"]?\s*resid[eaou]nce"
RESIDENCE_VI = r"n[o0](?:i|[1l])?\s*thu[o0]ng\s*tr?u"
EXPIRY = r"(?:co|c[o0])\s*[i1l]?\s*[g9]ia(?:\s+[a-z])?\s*[\(\[]?\s*(?:tr[iyj1l]|t[1il])\s*den|date\s*of\s*expiry"
# ---- fixed values: parts of a misread expiry label: rule, part, which words may be it, the word it stands for, least
# gestalt ratio, endings that will do instead, letter it must begin with. A rule needs all its parts, a part one row.
EXPIRY_PARTS = (
    ("english", "date", "first", "date", 0.50, (), ""),
    ("english", "expiry", "later", "expiry", 0.55, ("piry",), ""),
    ("local", "gia", "any", "gia", 0.65, (), ""),
    ("local", "gia", "any", "cogia", 0.70, (), ""),
    ("local", "den", "last", "den", 0.62, ("den", "oen"), ""),
    ("local", "whole", "glued", "cogiatriden", 0.70, (), "c"),
)

# ---- fixed values: label patterns, continued
NAME_LABEL = r"(?:ho\s*va\s*ten|full\s*name)"
BIRTH_LABEL = r"(?:ngay\s*sinh|date\s*of\s*birth)"
GENDER_LABEL = r"(?:gioi\s*tinh|sex)"
NATIONALITY_LABEL = r"(?:quoc\s*tich|nationality)"
ORIGIN_LABEL = r"(?:que\s*quan|place\s*of\s*origin)"
RESIDENCE_LABEL = r"(?:noi\s*thuong\s*tru|place\s*of\s*residence)"
EXPIRY_LABEL = r"(?:co\s*gia\s*tri\s*den|gia\s*tri\s*den|date\s*of\s*expiry|expiry\s*date|date\s*of\s*expir[yv])"
GENDER_LABEL_RECOVER = r"\b(?:gioi\s*tinh|sex)\b"
NATIONALITY_LABEL_WORD = r"\b(?:quoc\s*tich|nationality)\b"
NAME_LABEL_RECOVER = r"(?:ho\s*va\s*ten\s*/?\s*|full\s*name\s*:?)"
NATIONALITY_LABEL_RECOVER = r"(?:quoc\s*tich\s*/?\s*|nationality\s*:?)"
ORIGIN_LABEL_RECOVER = rf"(?:que\s*quan(?:\s*/?\s*(?:{ORIGIN_EN}))?|{ORIGIN_EN})\s*:?"
RESIDENCE_LABEL_RECOVER = rf"(?:{RESIDENCE_VI}(?:\s*/?\s*(?:{RESIDENCE_EN}))?|{RESIDENCE_EN})\s*:?"
ORIGIN_STOP_RECOVER = rf"(?:{RESIDENCE_VI}|{RESIDENCE_EN}|date\s*of\s*expiry)"
RESIDENCE_STOP_RECOVER = r"\b(?:date\s*of\s*expiry)\b"
NAME_HEADING = "FULL NAME|HO VA TEN|HOVA TEN"
ENGLISH_HALF = r"^\s*/?\s*(?:full\s*name|date\s*of\s*birth|sex|nationality|place\s*of\s*origin|place\s*of\s*residence)\s*:?\s*"
EXPIRY_WITH_DATE = r"(?:co|c[o0])\s*[g9]ia\s*(?:tri|t[1il])\s*den\s*\d{1,2}[/-]\d{1,2}[/-]\d{4}"
STOP_LABEL_LINE = (
    r"(?:ho\s*va\s*ten|full\s*name|ngay\s*sinh|date\s*of\s*birth|gioi\s*tinh|sex|quoc\s*tich|nationality|que\s*quan|place\s*of\s*origin"
    r"|noi\s*thuong\s*tru|place\s*of\s*residence|date\s*of\s*expiry|co\s*gia\s*tri\s*den)"
)
STOP_LABEL = (
    r"\b(?:ho\s*va\s*ten|full\s*name|ngay\s*sinh|date\s*of\s*birth|gioi\s*tinh|sex|quoc\s*tich|nationality|que\s*quan|"
    + ORIGIN_EN + "|" + RESIDENCE_VI + "|" + RESIDENCE_EN + "|" + EXPIRY + ")"
)
FIELD_START = (
    r"^(?:so(?:\s*/\s*no)?|ho\s*va\s*ten|full\s*name|ngay\s*sinh|date\s*of\s*birth|gioi\s*tinh|sex|quoc\s*tich|nationality|que\s*quan|place\s*of\s*origin"
    r"|noi\s*thuong\s*tru|place\s*of\s*residence|co\s*gia\s*tr[iyj1l]\s*den|date\s*of\s*expiry)\b"
)
LOCAL_LABEL = r"(?:gioi\s*tinh|quoc\s*tich|que\s*quan|noi\s*thuong\s*tru|ngay\s*sinh|ho\s*va\s*ten)"
EXPIRY_LOOK = r"(?:co|gia|tri|den|expiry|\d{1,2}/\d{1,2}/\d{4})"
ADDRESS_LOOK = r"(?:noi\s*thuong\s*tru|place\s*of\s*residence|thi\s*tran|phuong|xa|khom|thon|tam\s*binh)"
CONTENT_PATTERNS = (
    (r"can\s*cuoc\s*cong\s*dan", 3.0), (r"citizen\s*identity\s*card", 2.0), (r"ho\s*va\s*ten|full\s*name", 2.0), (r"ngay\s*sinh|date\s*of\s*birth", 2.0), (r"gioi\s*tinh|\bsex\b", 1.0),
    (r"quoc\s*tich|nationality", 1.0), (r"que\s*quan|place\s*of\s*origin", 1.0), (r"noi\s*thuong\s*tru|place\s*of\s*residence", 1.0), (r"co\s*gia\s*tri\s*den|date\s*of\s*expiry", 1.0),
)
NOT_ADDRESS_LABELS = ("full name", "date of birth", "gioi tinh", "sex", "quoc tich", "nationality", "date of expiry", "co gia tri den")
NOISE_WORDS = ("fiaco", "onyu", "notmuong", "uliesicetce", "deleiabexpiry", "codauden", "ogiatno1n", "fresidencethon", "thackcks", "thackho")

# ---- fixed values: label aliases of layout extraction
ALIASES = {
    "idNumber": ("Số", "So", "Số định danh cá nhân", "So dinh danh ca nhan", "No", "No."),
    "fullName": ("Họ và tên", "Ho va ten", "Họ tên", "Ho ten", "Full name"),
    "dateOfBirth": ("Ngày sinh", "Ngay sinh", "Date of birth", "Birth date"),
    "gender": ("Giới tính", "Gioi tinh", "Sex", "Gender"),
    "nationality": ("Quốc tịch", "Quoc tich", "Nationality"),
    "placeOfOrigin": ("Quê quán", "Que quan", "Place of origin", "Place of birth"),
    "placeOfResidence": ("Nơi thường trú", "Noi thuong tru", "Nơi cư trú", "Noi cu tru", "Place of residence", "Permanent residence"),
    "dateOfExpiry": ("Có giá trị đến", "Co gia tri den", "Ngày hết hạn", "Ngay het han", "Date of expiry", "Valid until"),
}
BELOW_FIRST = ("fullName", "placeOfOrigin", "placeOfResidence")
MIN_SIMILARITY, MIN_SIMILARITY_ID = 0.60, 0.55

# ---- fixed values: regions of the template sheet (field, x1, y1, x2, y2)
SHEET = (1000, 630)
REGIONS = (
    ("idNumber", 390, 255, 790, 325), ("fullName", 295, 340, 700, 405), ("dateOfBirth", 580, 390, 830, 440), ("gender", 455, 425, 590, 475), ("nationality", 790, 425, 995, 475),
    ("placeOfOrigin", 290, 490, 760, 550), ("placeOfResidence", 290, 535, 995, 630), ("dateOfExpiry", 15, 545, 300, 615), ("portrait", 20, 200, 270, 520),
)

# ---- fixed values: the same of the earlier sheet
REGIONS_V1 = (
    ("idNumber", 335, 205, 740, 285), ("fullName", 285, 270, 790, 355), ("dateOfBirth", 575, 330, 850, 410), ("gender", 285, 375, 505, 445), ("nationality", 570, 375, 900, 445),
    ("placeOfOrigin", 275, 425, 940, 515), ("placeOfResidence", 270, 495, 960, 600), ("dateOfExpiry", 15, 490, 285, 590), ("portrait", 20, 200, 270, 505),
)

# ---- fixed values: source priority by field; identifiers never come from raw text
PRIORITIES = {
    "idNumber": ("FULL_CARD_OCR", "FIELD_OCR"),
    "fullName": ("FULL_CARD_OCR", "RAW_TEXT_RECOVERY", "FIELD_OCR"),
    "dateOfBirth": ("RAW_TEXT_RECOVERY", "FULL_CARD_OCR", "FIELD_OCR"),
    "gender": ("RAW_TEXT_RECOVERY", "FULL_CARD_OCR", "FIELD_OCR"),
    "nationality": ("RAW_TEXT_RECOVERY", "FULL_CARD_OCR", "FIELD_OCR"),
    "placeOfOrigin": ("RAW_TEXT_RECOVERY", "FULL_CARD_OCR", "FIELD_OCR"),
    "placeOfResidence": ("RAW_TEXT_RECOVERY", "FULL_CARD_OCR", "FIELD_OCR"),
    "dateOfExpiry": ("RAW_TEXT_RECOVERY", "FULL_CARD_OCR", "FIELD_OCR"),
}

# ---- fixed values: the earlier priority: the field reading first, raw text for birth dates and nationality only
PRIORITIES_V1 = {
    "idNumber": ("FIELD_OCR", "FULL_CARD_OCR"),
    "fullName": ("FIELD_OCR", "FULL_CARD_OCR"),
    "dateOfBirth": ("FIELD_OCR", "FULL_CARD_OCR", "RAW_TEXT_RECOVERY"),
    "gender": ("FIELD_OCR", "FULL_CARD_OCR"),
    "nationality": ("FIELD_OCR", "FULL_CARD_OCR", "RAW_TEXT_RECOVERY"),
    "placeOfOrigin": ("FIELD_OCR", "FULL_CARD_OCR"),
    "placeOfResidence": ("FIELD_OCR", "FULL_CARD_OCR"),
    "dateOfExpiry": ("FIELD_OCR", "FULL_CARD_OCR"),
}

# ---- fixed values: validation messages in order
ERRORS = {
    "idNumber": "Số CCCD không hợp lệ",
    "fullName": "Họ tên không hợp lệ",
    "dateOfBirth": "Ngày sinh không hợp lệ",
    "gender": "Giới tính không hợp lệ",
    "nationality": "Quốc tịch không hợp lệ",
}
NULL_WORDS = ("", "none", "null", "unknown", "not found")
