"""Cues of articles: what marks a mood, an event, an industry or talk of stocks. All are fixed values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from quillgraph.functions.text import EVENT_IMPACT, EVENT_PATTERNS

#: Words near a symbol that tell that stocks are meant.
STOCK_CONTEXT = ("cổ phiếu", "co phieu", "mã ", "ma ck", "chứng khoán", "chung khoan", "cp ", "hose", "hnx", "hsx", "upcom", "sàn ", "san ")
#: Words before a symbol after which it is part of a place's name.
FALSE_FRIENDS = {"HCM": ("tp.", "tp ", "t.p.", "thành phố ", "thanh pho ")}
#: Signs of text around a symbol, and before it, that are looked at.
REACH, BEFORE = 40, 24
#: Cues of a good and of a bad mood.
POSITIVE = (
    "tăng", "tăng trưởng", "lợi nhuận tăng", "doanh thu tăng", "tích cực", "phục hồi", "hợp đồng mới", "ký kết", "mở rộng", "thành công", "vượt kế hoạch", "khởi sắc", "đột phá", "tăng mạnh",
    "tăng vọt", "tăng cao", "tăng kỷ lục", "lợi nhuận cao", "dẫn đầu", "đầu tư mới", "ra mắt", "hợp tác", "liên doanh", "xuất khẩu tăng", "thị phần tăng", "cổ tức", "chia cổ tức", "trúng thầu", "thắng thầu",
    "khả quan", "vượt dự báo", "vượt kỳ vọng", "lãi tăng", "lãi ròng tăng", "lợi nhuận ròng tăng", "lãi kỷ lục", "kết quả kinh doanh khả quan",
)
NEGATIVE = (
    "giảm", "lỗ", "sụt giảm", "tiêu cực", "vi phạm", "xử phạt", "rủi ro", "khó khăn", "thua lỗ", "âm", "nợ xấu", "giảm mạnh", "giảm sâu", "sụt", "yếu", "đình chỉ", "thu hồi", "phạt",
    "thanh tra", "điều tra", "cảnh báo", "mất thị phần", "hủy hợp đồng", "thu hẹp", "sa thải", "cắt giảm", "lãi giảm", "lợi nhuận giảm", "hạ dự báo", "hạ dự báo lợi nhuận",
    "giảm dự báo", "cắt giảm dự báo", "kém khả quan", "dưới kỳ vọng", "thấp hơn kỳ vọng",
)
#: Words that say which way a percentage moved.
UP, DOWN = "tăng", "giảm"
#: Names of event families.
EVENT_LABELS = {
    "profit_growth": "Lợi nhuận/doanh thu tăng", "profit_decline": "Lợi nhuận/doanh thu giảm", "dividend": "Chia cổ tức", "merger": "Sáp nhập/mua lại", "new_contract": "Ký hợp đồng/trúng thầu mới",
    "penalty": "Vi phạm/xử phạt", "leadership_change": "Thay đổi lãnh đạo", "share_issuance": "Phát hành cổ phiếu/tăng vốn", "expansion": "Mở rộng đầu tư/kinh doanh",
}
#: Cues of industries.
INDUSTRIES = {
    "Ngân hàng": ["ngân hàng", "tín dụng", "lãi suất huy động", "ngành ngân hàng"], "Bất động sản": ["bất động sản", "địa ốc", "chung cư", "dự án nhà ở", "thị trường nhà đất"],
    "Chứng khoán": ["chứng khoán", "vn-index", "vnindex", "thị trường chứng khoán", "sàn giao dịch"], "Thép": ["ngành thép", "giá thép", "sản lượng thép", "tôn thép"],
    "Dầu khí": ["dầu khí", "giá dầu", "xăng dầu", "khí đốt", "petrovietnam"], "Công nghệ": ["công nghệ thông tin", "chuyển đổi số", "ngành công nghệ", "phần mềm"],
    "Hàng tiêu dùng": ["hàng tiêu dùng", "bán lẻ tiêu dùng", "fmcg"], "Đồ uống": ["ngành đồ uống", "bia rượu", "nước giải khát"], "Bán lẻ": ["ngành bán lẻ", "chuỗi bán lẻ", "siêu thị"],
    "Dược phẩm": ["ngành dược", "dược phẩm", "thuốc chữa bệnh"], "Công nghiệp": ["ngành công nghiệp", "sản xuất công nghiệp", "khu công nghiệp"],
    "Bảo hiểm": ["bảo hiểm nhân thọ", "bảo hiểm phi nhân thọ", "ngành bảo hiểm"], "Hàng không": ["hàng không", "sân bay", "hãng bay"], "Viễn thông": ["viễn thông", "nhà mạng"],
    "Dệt may": ["dệt may", "ngành may mặc", "xuất khẩu dệt may"], "Thủy sản": ["thủy sản", "xuất khẩu tôm cá", "nuôi trồng thủy sản"], "Xây dựng": ["ngành xây dựng", "nhà thầu xây dựng", "vật liệu xây dựng"],
    "Nông nghiệp": ["ngành nông nghiệp", "nông sản", "xuất khẩu gạo"],
}
#: Sentences of reasons; {n} is a number, {q} quotes, {name} a name.
SAYS = {
    "moves": "Phát hiện số liệu định lượng trong bài (bằng chứng mạnh hơn từ khóa đơn thuần): {q}",
    "positive": "Phát hiện {n} từ khóa tích cực trong bài: {q}",
    "negative": "Phát hiện {n} từ khóa tiêu cực trong bài: {q}",
    "neither": "Không tìm thấy từ khóa tích cực hay tiêu cực rõ ràng trong bài báo",
    "event": "Sự kiện '{name}' được nhận diện qua cụm từ: {q}",
    "companies": "Bài báo đề cập trực tiếp đến: {q}",
    "industry_cue": "Ngành '{name}' được suy ra từ cụm từ trong bài: {q}",
    "industry_symbol": "Ngành '{name}' được suy ra từ công ty/mã cổ phiếu được nhắc đến",
    "Positive": "=> Kết luận sentiment tổng thể của bài báo: TÍCH CỰC (có xu hướng hỗ trợ giá cổ phiếu tăng)",
    "Negative": "=> Kết luận sentiment tổng thể của bài báo: TIÊU CỰC (có xu hướng gây áp lực giảm giá cổ phiếu)",
    "Neutral": "=> Kết luận sentiment tổng thể của bài báo: TRUNG LẬP (chưa đủ tín hiệu rõ ràng để nghiêng hẳn về một chiều)",
}


@dataclass(frozen=True)
class Cues:
    """What an analysis looks for; another language or a table of keywords gives its own."""

    positive: Sequence[str] = POSITIVE
    negative: Sequence[str] = NEGATIVE
    up: str = UP
    down: str = DOWN
    events: Mapping[str, Sequence[str]] = field(default_factory=lambda: EVENT_PATTERNS)
    labels: Mapping[str, str] = field(default_factory=lambda: EVENT_LABELS)
    weights: Mapping[str, int] = field(default_factory=lambda: EVENT_IMPACT)
    industries: Mapping[str, Sequence[str]] = field(default_factory=lambda: INDUSTRIES)
    context: Sequence[str] = STOCK_CONTEXT
