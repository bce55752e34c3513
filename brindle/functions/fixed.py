"""Word lists, tables, classes of characters and patterns that must be as they are for results to be right."""

# Kinds of documents (survey X6). Words in the file name, then words in the first 5000 characters, in turn.
GENERIC = "Genel Doküman"
NAME_KINDS = (
    ("İstihbarat Raporu", ("istihbarat",)),
    ("Teklif Özeti", ("teklif",)),
    ("Performans Değerlendirmesi", ("performans",)),
    ("Mali Veri Tabloları", ("mali", "solo", "konsolide", "bilanco", "bilanço")),
)
TEXT_KINDS = (
    ("İstihbarat Raporu", ("istihbarat", "diğer bankalardaki", "bankacılık riskleri")),
    ("Teklif Özeti", ("limit bilgileri", "teminat koşulları", "rating değerleri")),
    ("Mali Veri Tabloları", ("net satışlar", "aktif toplam", "özkaynak")),
)
HTML_KINDS = {"teklif": "Teklif Özeti", "performans": "Performans Değerlendirmesi", "mali_veri": "Mali Veri Tabloları"}

# Glossaries by file name, and phrases of definitions (survey X7).
DICTIONARY_NAMES = ("sözlük", "sozluk", "dictionary", "açıklama", "aciklama", "rehber", "tanım", "tanim", "veri_sozlugu", "data_dict")
DEFINITIONS = ("bu bölüm", "bu alan", "bu sütun", "açıklama:", "tanım:", "içerik:", "ne anlama gelir", "bu tablo", "bu rapor", "bu doküman")

# Signals of credit reports (survey X8).
CREDIT_SIGNALS = ("banka istihbarat", "memzuç bilgi", "memzuc bilgi", "limit risk bilgi", "kredi istihbarat")

# Words of questions that want numbers, and the letters of question words (survey X17, X19).
NUMBER_WORDS = (
    "kaç", "ne kadar", "tutar", "toplam", "miktar", "değer", "oran", "%", "rakam", "sayısal", "risk", "limit", "borç", "aktif", "pasif",
    "özkaynak", "satış", "kar", "zarar", "bilanço", "gelir tablosu",
)
LETTERS = "A-Za-zÜÖÇŞİĞüöçşığ"

# Heads of currency columns, currency codes, codes of amounts in running text, letters of items (survey H9, H13, H16, H17).
CURRENCY_HEADS = ("PCN", "P.C.N", "PARA CİNSİ", "DÖVİZ", "DÖVİZ CİNSİ", "CUR", "CURRENCY", "P.CİNSİ", "PARA BIRIMI", "PARA BİRİMİ")
CURRENCIES = ("TRY", "USD", "EUR", "GBP", "CHF", "JPY", "TL")
MONEY = "TRY|USD|EUR|GBP|TL"
ITEM_LETTERS = "a-zğüşıöç"

# Sections of proposals and their titles, and the ids of headings (survey H15).
SECTION_TITLES = {
    "Header": "BAŞLIK BİLGİLERİ",
    "CommitteeName": "KOMİTE ADI",
    "Limits": "LİMİT BİLGİLERİ",
    "RatingValues": "RATING DEĞERLERİ",
    "CautionConditions": "LİMİT VE TEMİNAT KOŞULLARI",
    "Guarantors": "KEFİLLER",
    "Constant": "ŞUBE TEKLİFİ VE KREDİ MÜDÜRLÜĞÜ GÖRÜŞÜ",
    "TeklifDetailInfo": "TEKLİF DETAY BİLGİLERİ",
    "OtherInfo": "GENEL DEĞERLENDİRME VE ORTAKLIK YAPISI",
}
HEADING_IDS = ("SM_KTO_SubeTeklifi", "SM_KTO_KrediMudurluguGorusu", "KunyeSummary", "PartnershipStructures")

# Inline tags that a vision model leaves (survey X5).
LEFTOVER_TAGS = "span|div|p|font|b|i|u|em|strong"
