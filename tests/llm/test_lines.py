"""Line chunks of texts with blank lines, and of runs among foreign lines."""

from palisade.llm import line_dedup


def run_of(n, name="line"):
    return [f"{name} {i} of the text" for i in range(n)]


def test_copies_with_blank_lines_go():
    text = "\n\n".join(run_of(40)).encode()
    gone = {i for a, n, _ in line_dedup.eligible(text) for i in range(a, a + n)}
    assert len([x for i, x in enumerate(text.split(b"\n")) if x.strip() and i not in gone]) <= 1
    assert all(sum(bool(x.strip()) for x in c.split(b"\n")) > 1 for _, _, c in line_dedup.eligible(text))


def test_blank_lines_do_not_move_chunks():
    lines = run_of(60)
    plain = [len([x for x in c.split(b"\n") if x.strip()]) for _, _, c in line_dedup.eligible("\n".join(lines).encode())]
    parted = [len([x for x in c.split(b"\n") if x.strip()]) for _, _, c in line_dedup.eligible("\n \n\n".join(["", *lines, ""]).encode())]
    assert plain == parted
    for text in ("", "\n", "\n\na", "a\n\n", " \n\t\nb\n\nc\n"):
        whole = line_dedup.chunks(text.encode())
        assert sum(n for _, n in whole) == text.count("\n") + 1


def test_foreign_lines_do_not_move_the_end_of_a_run():
    """The line before a run doesn't decide where a chunk ends within it."""
    ends = set()
    for i in range(20):
        text = [*run_of(1, f"foreign {i}"), *run_of(2, f"more {i}"), *run_of(40)]
        ends.add(tuple(a + n for a, n in line_dedup.chunks("\n".join(text).encode()) if a + n > 10))
    assert len(ends) == 1
