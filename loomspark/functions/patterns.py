"""Patterns of legal text, as Java regular expressions.

Fixed values: they must accept the same strings as the notation they describe. ``(?iU)`` folds case and reads ``\\s``, ``\\w`` and
``\\b`` over all of Unicode. Groups are numbered.
"""

I = "(?iU)"  # noqa: E741

PART = I + r"^\s*PHẦN(?:\s+THỨ)?\s+([^:.\-\n]+?)(?:\s*[:.\-]\s*(.+))?\s*$"
CHAPTER = I + r"^\s*CHƯƠNG\s+([IVXLCDM]+|\d+[A-Za-z]?)(?:\s*[:.\-]\s*(.*))?\s*$"
SECTION = I + r"^\s*MỤC\s+([IVXLCDM]+|\d+[A-Za-z]?)(?:\s*[:.\-]\s*(.*))?\s*$"
ARTICLE = I + r"^\s*Điều\s+(\d+[A-Za-z]?)(?:\s*[.:]\s*(.*))?\s*$"
FIRST_ARTICLE = I + r"^\s*Điều\s+\d+[A-Za-z]?\s*[.:]?"
ADMIN_TAIL = I + r"^\s*(?:Nơi\s+nhận\s*:|KT\.\s*[A-ZÀ-ỸĐ\s]+\b|TM\.\s*[A-ZÀ-ỸĐ\s]+\b|TUQ\.\s*[A-ZÀ-ỸĐ\s]+\b|TL\.\s*[A-ZÀ-ỸĐ\s]+\b|CHỦ\s+TỊCH\b|PHÓ\s+CHỦ\s+TỊCH\b|BỘ\s+TRƯỞNG\b|THỨ\s+TRƯỞNG\b|GIÁM\s+ĐỐC\b|PHÓ\s+GIÁM\s+ĐỐC\b)"
APPENDIX_START = I + r"^\s*(?:PHỤ\s+LỤC\b.*|DANH\s+MỤC\b.*|NỘI\s+DUNG\s+QUY\s+TRÌNH\b.*|QUY\s+TRÌNH\s+GIẢI\s+QUYẾT\b.*|\(?\s*Ban\s+hành\s+kèm\s+theo\b.*)\s*$"
APPENDIX_EXPLICIT = I + r"^\s*PHỤ\s+LỤC\b"
APPENDIX_INLINE = I + r"\b(?:PHỤ\s+LỤC|DANH\s+MỤC|NỘI\s+DUNG\s+QUY\s+TRÌNH)\b"
ADMIN_INLINE = I + r"\bNơi\s+nhận\s*:"

DOCUMENT_NUMBER = r"\d+(?:/\d{4})?/[A-ZĐ0-9]+(?:-[A-ZĐ0-9]+)*"
DOCUMENT_TYPE = r"Bộ\s+luật|Luật|Nghị\s+định|Thông\s+tư|Nghị\s+quyết|Quyết\s+định|Chỉ\s+thị"
_POINT = r"(?:điểm\s+([a-zđ])\s+)?"
_CLAUSES = r"(?:(khoản\s+\d+[a-z]?(?:\s*,?\s*(?:và\s+)?khoản\s+\d+[a-z]?)*)\s+)?"
#: Groups: point, clauses, article, document number.
EXTERNAL_REFERENCE = I + rf"(?:{_POINT}{_CLAUSES}(?:Điều\s+(\d+[a-z]?)\s+)?)?(?:{DOCUMENT_TYPE})\s+(?:số\s+)?({DOCUMENT_NUMBER})"
#: Groups: point, clauses, article.
INTERNAL_REFERENCE = I + rf"{_POINT}{_CLAUSES}Điều\s+(\d+[a-z]?)"
ARTICLE_ONLY = I + r"\bĐiều\s+(\d+[a-z]?)\b"
#: Groups: section, appendix.
APPENDIX_REFERENCE = I + r"\bMục\s+([IVXLCDM]+|\d+)\s+Phụ\s+lục\s+([IVXLCDM]+|\d+)\b"
CLAUSE_NUMBER = I + r"khoản\s+(\d+[a-z]?)"
BASED_ON = I + r"\bcăn\s+cứ\b"
REPEAL = I + r"\b(hết\s+hiệu\s+lực|bãi\s+bỏ|chấm\s+dứt\s+hiệu\s+lực)\b"
AMEND = I + r"\b(sửa\s+đổi|bổ\s+sung|thay\s+thế)\b"

LEVEL_WORDS = "một|mot|hai|ba|bốn|bon|năm|nam|sáu|sau|bảy|bay|tám|tam|chín|chin|mười|muoi"
NODE_PART = I + rf"^\s*Phần\s+(?:(?:thứ\s+)?(?:{LEVEL_WORDS}|[IVXLCDM]+|\d+|[A-ZĐ]))(?:\s*[:.\-(]|\s+|$)"
NODE_CHAPTER = I + r"^\s*Chương\s+(?:[IVXLCDM]+|\d+|[A-ZĐ])(?:\s*[:.\-]|\s+|$)"
NODE_SECTION = I + r"^\s*Mục\s+(?:[IVXLCDM]+|\d+|[A-ZĐ])(?:\s*[:.\-]|\s+|$)"
NODE_ARTICLE = I + r"^\s*Điều\s+(\d+[A-Za-zĐđ]?)\b"

EVIDENCE_TOKEN = "[0-9A-Za-zÀ-ỹĐđ]+"
STOPWORDS = ("ai", "bao", "bị", "bởi", "các", "cái", "cho", "có", "của", "đã", "đang", "đến", "để", "gì", "hay", "là", "làm", "một", "những", "ở", "ra", "sau", "sẽ", "theo", "thì", "trong", "từ", "và", "về", "với")
LIST_MARK = I + r"\s+(?=(?:\d{1,3}[.)]|[a-zđ][.)]|[-–•])\s+)"
SENTENCE_END = r"(?U)(?:\n+|(?<=[.!?;:])\s+(?=[A-ZÀ-ỸĐ0-9]))"
LEGAL_SIGNAL = r"(?U)\b(?:điều|khoản|điểm|đối tượng|điều kiện|mức|thời hạn|thủ tục|hồ sơ|khoảng cách|trường hợp|quy định)\b"
REFUSALS = ("không có câu trả lời", "không có đáp án", "không tìm thấy câu trả lời", "không tìm thấy thông tin", "không đủ thông tin", "chưa đủ thông tin", "không đủ căn cứ", "chưa đủ căn cứ", "không thể trả lời", "không thể xác định", "tài liệu không đề cập", "nguồn không đề cập")
FORBIDDEN = ("<think>", "[n]", "<legal_sources>", "<user_question>", "nếu không có đáp án nào phù hợp")
LEAKAGE = ("<LEGAL_SOURCES>", "</LEGAL_SOURCES>", "<USER_QUESTION>", "</USER_QUESTION>", "Nếu không có đáp án nào phù hợp")
