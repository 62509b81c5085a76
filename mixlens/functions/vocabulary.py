"""Word lists, patterns and texts that results depend on."""

from __future__ import annotations

import json
import pkgutil

# Levels of rewriting and their field names.
LEVELS = ("level_0_clean", "level_1_mild", "level_2_jaksel", "level_3_adversarial")

# Task categories, their weights and keywords, in order.
CATEGORIES = {
    "logical_reasoning": (0.25, "logika deduksi silogisme kesimpulan premis argumen valid inferensi reasoning logic jika maka karena sebab akibat".split()),
    "mathematical_reasoning": (0.20, "hitung matematika rumus angka persamaan jumlah kurang kali bagi persen berapa total rata-rata statistik".split()),
    "creative_writing": (0.20, "cerita puisi narasi kreatif tulis dongeng fiksi karakter plot dialog deskripsi imajinatif kisah".split()),
    "information_extraction": (0.20, "rangkum ekstrak informasi fakta data ringkasan poin utama sebutkan daftar identifikasi temukan cari".split()),
    "coding": (0.15, "kode program fungsi algoritma python javascript code script debug error variabel loop array class".split()),
}
# Patterns tried in order when no keyword occurs; the last category is the default.
HEURISTICS = (
    (r"\d+\s*[\+\-\*\/\=]", "mathematical_reasoning"),
    (r"(def |function |class |import |print\()", "coding"),
    (r"(ceritakan|tuliskan|buatkan cerita)", "creative_writing"),
    (r"(jelaskan|apa itu|mengapa)", "information_extraction"),
)
DEFAULT_CATEGORY = "logical_reasoning"

# Constraint texts and patterns.
KEYWORD_REQUIREMENT = "Pastikan jawaban mengandung kata: {}."
LENGTH_REQUIREMENT = "Jawab dalam {}-{} kata."
FORMATS = {
    "json": ("Jawab dalam format JSON.", r"\{[\s\S]*\}|\[[\s\S]*\]"),
    "numbered_list": ("Gunakan format daftar bernomor.", r"^\s*\d+[\.\)]"),
    "bullet_list": ("Gunakan format poin-poin.", r"^\s*[-•*]"),
    "table": ("Tampilkan jawaban dalam format tabel.", r"\|.+\|"),
}
FORMAT_PREFERENCES = {
    "coding": ["json", "numbered_list"],
    "mathematical_reasoning": ["json", "numbered_list"],
    "information_extraction": ["table", "numbered_list", "bullet_list"],
    "logical_reasoning": ["numbered_list", "bullet_list"],
    "creative_writing": ["bullet_list", "numbered_list"],
}
FALLBACK_KEYWORDS = {
    "logical_reasoning": "kesimpulan sebab akibat valid logis inferensi premis argumen".split(),
    "mathematical_reasoning": "hasil total jumlah persentase rata-rata rumus perhitungan nilai solusi".split(),
    "creative_writing": "karakter plot konflik narasi dialog deskripsi suasana emosi".split(),
    "information_extraction": "ringkasan fakta informasi aspek elemen komponen".split(),
    "coding": "fungsi variabel output input parameter algoritma error".split(),
}
LAST_KEYWORDS = ["hasil", "jawaban"]
STOP_WORDS = """
yang ini itu kami kita mereka anda saya kamu dia sebuah suatu setiap para dan atau serta pula tetapi tapi namun agar maka jika
bila karena bahwa supaya pada dari untuk dengan dalam oleh ke kepada bagi tentang antara adalah ada akan tidak juga saja bisa
sudah dapat lebih harus perlu boleh telah sedang berikut tersebut diberikan contoh cara jenis tipe lain sama baru satu dua tiga
""".split()

# Markers of code-mixed text.
PARTICLES = "dong sih deh nih ya loh kan gitu".split()
RESPELLED = "plis rili litereli meik rait cek greit nais krezi apdet oke wow hei".split()
CONNECTORS = ["which", "that", "so that", "because", "actually", "i mean", "basically", "like", "literally", "by the way"]
CLAUSE_WORDS = """
the is are was were have has had make makes made that which this there your our their will would should could please ensure
include provide write give show list describe explain create generate
""".split()
SUFFIX_PATTERN = r"\b[a-z]{3,}(?:ly|ness)\b"
ENGLISH_SUFFIXED = """
really literally basically actually finally generally specifically clearly simply exactly already directly easily quickly
strongly properly likely only nearly closely
""".split()

# Formal word and its colloquial form, in the order they are applied: the file beside this module by default.
LEXICON = [(k, v) for k, v in json.loads(pkgutil.get_data(__package__, "lexicon.json")).items() if k != v]

# How lines and phrases that state a constraint begin.
CONSTRAINT_LINE = r"^(?:pastikan\s+jawaban\s+mengandung|jawab\s+\S+\s+\d|jawab\s+\S+\s+format|gunakan\s+format|tampilkan\s+jawaban)"
CONSTRAINT_OPENER = (
    r"\b(?:pastikan\s+jawaban\s+mengandung|pastiin\s+(?:jawaban|ada\s+kata)|(?:make|meik)\s+sure\s+jawaban"
    r"|(?:jawab|jwb)\s+(?:dalam|dlm)\b|gunakan\s+format|(?:pake|pakai|gunain|use)\s+format|tampilkan\s+jawaban)"
)
KEYWORD_TERMS = r"mengandung kata:\s*(.+?)\.?$"
LENGTH_RANGE = r"(\d+)\s*[-–]\s*(\d+)"

# Hosts of the own machine.
LOCAL_HOSTS = ["localhost", "127.0.0.1", "0.0.0.0", "::1"]
CONSTRAINT_TYPES = ("keyword", "length", "format")
METRICS = {"constraint_pass_rate": "cpr", "semantic_score": "semantic", "combined_score": "composite"}
