import os
from functools import wraps


def traced(fn):
    """Wrap a function.

    Keeps the name.
    """
    @wraps(fn)
    def inner(*args, **kwargs):
        log(f"call {fmt(fn)}", "not_a_call(")
        return fn(*args, **kwargs)

    return inner


class Shape(Base, mixins.Named, make_base(3), Generic[int], metaclass=Meta):
    """def fake(self): pass"""

    @property
    @cached(size=8)
    def area(self):
        # def comment_only():
        text = """
def not_a_function():
    other()
"""
        return self.width() * compute(
            self.height(),
        self.width(),
        )

    class Inner:
        async def run(
            self,
            x,
        ):
            'One line.'
            if x:

                await self.step(x)
            # trailing comment

    def last(self): return os.path.join("a", 'b')

@decorated
def tail(a, b=default()):
    return [g(i) for i in range(a)] + tail(b)
x = tail(1)
