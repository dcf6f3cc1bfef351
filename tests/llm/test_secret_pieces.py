"""Short hex keys, tokens beside placeholders and random letters."""

import random
import re

from broadsheet.llm import secret_scan

from .conftest import frame
from .test_native import no_python


def test_hex_of_a_window_is_judged(spark):
    keys = ["9f8e7d6c5b4a39281706", "9F8E7D6C5B4A3928170", "9F8E7D6C5B4A39281706AB"]
    got = secret_scan.scan_secrets(frame(spark, [(i, f"k {k}", "en", "s") for i, k in enumerate(keys)])).orderBy("doc_id").collect()
    assert [r["spans"].split(",")[0] for r in got] == ["entropy_hex:2:22", "", "entropy_hex:2:24"]


def test_a_placeholder_takes_its_piece_only(spark):
    key = "q8Zt3Lw9Xb5Rk1Vn7Hc4Yd6Mf2Gs0Jp8Tq3Wz5Be"
    texts = [f"sample-app/{key}", f"{key}/example", f"see sample{key}", "your-api-key-goes-here-please/sample", "getElementAndReturnValue", "parseHTMLDocumentFromString", "qWzRtYpLkJhGfDsXcVbNmQw", "the-quick-brown-fox-jumps-over", "sample/" + "a1-" * 300]
    df = secret_scan.scan_secrets(frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]))
    assert no_python(df)
    got = [r["spans"] for r in df.orderBy("doc_id").collect()]
    first, second = (re.fullmatch(r"entropy_base64:(\d+):(\d+)", g) for g in got[:2])
    assert 6 <= int(first[1]) <= 11 and int(first[2]) == 51 and int(second[1]) == 0 and 40 <= int(second[2]) <= 41
    assert got[2:6] == ["", "", "", ""] and got[6].startswith("entropy_base64:0:") and got[7:] == ["", ""]


def test_names_match_in_linear_time():
    rng = random.Random(1)
    for text in ("a" * 50_000 + "1", "aB" * 20_000, "-a" * 20_000 + "1", "".join(rng.choice("ab-B") for _ in range(50_000)) + "1"):
        re.search(secret_scan.ALLOWED.replace(r"\z", r"\Z"), text)
