"""Operators do the whole job where a bound used to cut it."""

import numpy as np

from topicloom.llm import html_extract, media


def test_a_large_host_loses_the_runs_that_a_small_one_loses(spark, monkeypatch):
    rng = np.random.default_rng(4)
    word = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 4000, n))
    shared = [word(12) for _ in range(12)]
    blocks = [[word(15), f"{word(10)} {shared[i % 12]} {word(9)}", shared[(i + 5) % 12] if i < 12 else word(7)] for i in range(24)]
    blocks += [blocks[0], [word(3)], [], [word(9)], [" ".join(blocks[1][0].split()[:7])]]
    pages = [(i, f"http://Big.example/{i}", "".join(f"<div>{b}</div>" for b in bs)) for i, bs in enumerate(blocks)]
    df = spark.createDataFrame(pages + pages[3:4] + [(99, "http://other.example/", f"<div>{shared[0]}</div>")], "page_id long, url string, html string")
    want = {i: "\n\n".join(x) for i, x in enumerate(html_extract.without_boilerplate(blocks))} | {99: shared[0]}
    assert not any(x in want[i] for i in range(24) for x in shared)
    monkeypatch.setattr(html_extract, "GROUP_CHARS", 300)
    got = html_extract.extract(df).collect()
    assert len(got) == len(pages) + 2 and {r["page_id"]: r["text"] for r in got} == want


def test_landmarks_pair_peaks_and_survive_an_offset():
    rng = np.random.default_rng(6)
    words = ["".join(chr(c) for c in rng.integers(97, 123, n)) for n in rng.integers(2, 10, 300)]
    text = " ".join(rng.choice(words, 4000)).encode()
    samples = lambda b: np.frombuffer(media.padded(b), dtype=np.uint8)
    times, codes = media.landmarks(samples(text))
    bins, power = media.peaks(samples(text))
    peak = lambda t, b: power[t, b] > (power[t - 1, b] if t else -1) and power[t, b] >= (power[t + 1, b] if t + 1 < len(power) else -1)
    for t, c in zip(times.tolist(), codes.tolist(), strict=True):
        dt, ends = c & 255, (c >> 20, c >> 8 & 4095)
        assert any(bins[t, b] == ends[0] and bins[t + dt, b] == ends[1] and peak(t, b) and peak(t + dt, b) for b in range(len(media.BANDS)))
    moved = set(media.landmarks(samples(b"z" * 200 + text))[1].tolist())
    assert len(moved & set(codes.tolist())) > 0.15 * len(set(codes.tolist()))
