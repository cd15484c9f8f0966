"""What storing a text as media costs."""

import hashlib
import sys


def test_media_cost_of_a_text_and_its_bytes():
    """Calls that storing, reading and describing take; the bytes are those of the first round."""
    from quernstone.llm import jpeg, media

    text = "Streng geheim: 12 Äpfel, 7 Birnen. " * 900

    def go():
        stored = media.store(media.payload(text)[0])
        back, image = media.load(stored)
        return stored, back, media.feature(jpeg.rgb(image))

    stored, back, feature = go()
    assert back == media.payload(text)[0]
    assert hashlib.sha256(stored + feature.encode()).hexdigest() == "9dbc90362c466eece1a6b980af9db0a65ec0344039101099f35b3c772929a827"
    calls = [0]

    def count(frame, event, arg):
        calls[0] += event in ("call", "c_call")

    sys.setprofile(count)
    go()
    sys.setprofile(None)
    assert calls[0] < 2500, calls
