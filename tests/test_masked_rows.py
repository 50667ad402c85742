"""The masking state takes and gives rows, and asks the state store no more than it must."""

from pyspark.sql import Row

from vigilake.streaming import state


class Store:
    """A state variable, a handle and the times of a batch; every call on it is noted."""

    def __init__(self):
        self.value, self.calls = None, []

    def getValueState(self, *_):
        return self

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def clear(self):
        self.calls.append("clear")
        self.value = None

    def registerTimer(self, due):
        self.calls.append("register")

    def deleteTimer(self, due):
        self.calls.append("delete")

    def getCurrentProcessingTimeInMs(self):
        return 5


def made():
    store = Store()
    processor = state.LabelledDates(10)
    processor.init(store)
    return store, processor


def chunk(seq, data, last=False):
    return Row(stream_id="s", seq=seq, data=data, last=last)


def test_a_stream_that_ends_in_its_batch_leaves_the_store_alone():
    store, processor = made()
    got = [*processor.handleInputRows(("s",), iter([chunk(1, "/2/2003!", True), chunk(0, "x DOB: 1")]), store)]
    assert [tuple(r) for r in got] == [("s", 0, 0, "", "x "), ("s", 1, 0, " ", "DOB: 1/2/2003!")]
    assert store.calls == ["get"]


def test_what_is_held_goes_on_and_is_cleared():
    store, processor = made()
    first = [*processor.handleInputRows(("s",), iter([chunk(0, None), chunk(1, "a born on")]), store)]
    assert [tuple(r) for r in first] == [("s", 0, 0, "", ""), ("s", 1, 0, "", "a ")] and store.value == (" ", "born on", 1, 15)
    last = [*processor.handleInputRows(("s",), iter([chunk(2, " 1/1/2000", True)]), store)]
    assert [tuple(r) for r in last] == [("s", 2, 0, " ", "born on 1/1/2000")] and store.value is None
    assert store.calls == ["get", "register", "update", "get", "delete", "clear"]


def test_a_timer_hands_on_what_was_held():
    store, processor = made()
    assert [*processor.handleInputRows(("s",), iter([chunk(3, "DOB: 1/1/20")]), store)] == [("s", 3, 0, "", "")]
    assert [tuple(r) for r in processor.handleExpiredTimer(("s",), store, None)] == [("s", 3, 1, "", "DOB: 1/1/20")]
    assert store.value is None
