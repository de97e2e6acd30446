from strataquery.streaming.watch import Watcher


class Clock:
    now = 100.0

    def __call__(self):
        return self.now


def watcher(**options):
    clock, runs = Clock(), []
    return Watcher(lambda: runs.append(clock.now), clock=clock, **options), clock, runs


def test_notices_are_waited_out_and_run_once():
    own, clock, runs = watcher()
    for _ in range(4):
        own.notice()
        clock.now += 0.1
        assert not own.step()
    clock.now += 0.2
    assert own.step() and not own.step() and len(runs) == 1 and not own.dirty


def test_steady_changes_wait_no_longer_than_the_limit():
    own, clock, runs = watcher(longest=1.0)
    while not runs and clock.now < 110:
        own.notice()
        clock.now += 0.1
        own.step()
    assert 100.9 < runs[0] < 101.3


def test_a_notice_during_a_run_is_kept():
    clock = Clock()
    runs = []

    def run():
        runs.append(clock.now)
        if len(runs) == 1:
            own.notice()

    own = Watcher(run, clock=clock)
    own.notice()
    clock.now += 1
    assert own.step() and own.dirty
    clock.now += 1
    assert own.step() and not own.dirty and len(runs) == 2


def test_reconciliation_without_notices():
    own, clock, runs = watcher()
    clock.now += 29
    assert not own.step()
    clock.now += 1
    assert own.step() and not own.step()


def test_failures_back_off_and_recover():
    clock, tries = Clock(), []

    def run():
        tries.append(clock.now)
        if len(tries) < 8:
            raise OSError("busy")

    own = Watcher(run, clock=clock)
    own.notice()
    for _ in range(4000):
        clock.now += 0.1
        if own.step():
            break
    waits = [round(b - a) for a, b in zip(tries, tries[1:])]
    assert waits == [1, 2, 4, 8, 16, 30, 30] and not own.dirty
