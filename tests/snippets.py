"""Small sources in several languages, with what the index has to find in them."""

SNIPPETS = {
    "app/Player.kt": "class Player : Base() {\n    private val engine: Engine = Engine()\n    fun play(id: Int) {\n        engine.start(id)\n        helper()\n    }\n    fun helper() {\n        if (true) { log(\"x {\") }\n    }\n}\n",
    "app/Base.kt": "open class Base {\n    open fun play(id: Int) {\n    }\n    external fun nativeOpen(): Int\n}\n",
    "app/Engine.java": "public class Engine {\n    public void start(int id) {\n        prepare(id);\n    }\n    private void prepare(int id) {\n    }\n}\n",
    "lib/a.py": "def chain_one():\n    return chain_two()\n\n\nclass Box:\n    def open(self):\n        return self.fill()\n\n    def fill(self):\n        return chain_one()\n",
    "lib/b.py": "def chain_two():\n    return 2\n",
    "web/view.ts": "export class View {\n  render(x: number) {\n    return draw(x);\n  }\n}\nexport const draw = (x: number) => {\n  return x;\n};\n",
    "core/sound.rs": "pub struct Sound { rate: u32 }\nimpl Sound {\n    pub fn rate_of(&self) -> u32 {\n        compute_rate(self.rate)\n    }\n}\nfn compute_rate(r: u32) -> u32 {\n    r\n}\n",
    "srv/main.go": "package main\n\ntype Server struct {\n\tport int\n}\n\nfunc (s *Server) Run() {\n\tlisten_on(s.port)\n}\n\nfunc listen_on(p int) {\n}\n",
}

#: More languages, and a signature over several lines.
MORE = {
    "net/Room.cs": "public class Room\n{\n    public int Size { get; }\n    public Room(int n)\n    {\n        Fill(n);\n    }\n    private void Fill(int n)\n    {\n    }\n}\n",
    "ui/page.dart": "class Page {\n  void build(int x) {\n    paintAll(x);\n  }\n}\n\nvoid paintAll(int x) {\n}\n",
    "ios/Feed.swift": "class Feed {\n    func load(\n        id: Int,\n        more: Bool\n    ) {\n        refresh(id)\n    }\n    func refresh(_ id: Int) {\n    }\n}\n",
    "jni/Base.cpp": "int Java_app_Base_nativeOpen(int env) {\n    return 0;\n}\n",
}

#: Native code that calls into the virtual machine, and a component that uses another.
CALLBACKS = {
    "jni/Call.cpp": 'void notify_all(int env) {\n    jmethodID m = env->GetMethodID(cls, "helper", "()V");\n}\n',
    "web/App.tsx": "export function App() {\n  return <Panel size={1} />;\n}\nexport function Panel(p: any) {\n  return null;\n}\n",
}


def files(spark, snippets=None, mtime=1):
    rows = [(p, t, mtime, len(t)) for p, t in (snippets or SNIPPETS).items()]
    return spark.createDataFrame(rows, "path string, content string, mtime long, size long")


SPANS = [('app/Player.kt', 'Player', None, 'class', 1, 10), ('app/Player.kt', 'play', 'Player', 'method', 3, 6), ('app/Player.kt', 'helper', 'Player', 'method', 7, 9),
    ('app/Base.kt', 'Base', None, 'class', 1, 5), ('app/Base.kt', 'play', 'Base', 'method', 2, 3), ('app/Base.kt', 'nativeOpen', 'Base', 'method', 4, 5),
    ('app/Engine.java', 'Engine', None, 'class', 1, 7), ('app/Engine.java', 'start', 'Engine', 'method', 2, 4), ('app/Engine.java', 'prepare', 'Engine', 'method', 5, 6),
    ('lib/a.py', 'chain_one', None, 'function', 1, 4), ('lib/a.py', 'Box', None, 'class', 5, 10), ('lib/a.py', 'open', 'Box', 'method', 6, 8), ('lib/a.py', 'fill', 'Box', 'method', 9, 10),
    ('lib/b.py', 'chain_two', None, 'function', 1, 2), ('web/view.ts', 'View', None, 'class', 1, 5), ('web/view.ts', 'render', 'View', 'method', 2, 4), ('web/view.ts', 'draw', None, 'function', 6, 8),
    ('core/sound.rs', 'Sound', None, 'class', 1, 1), ('core/sound.rs', 'rate_of', 'Sound', 'method', 3, 5), ('core/sound.rs', 'compute_rate', None, 'function', 7, 9),
    ('srv/main.go', 'Server', None, 'class', 3, 5), ('srv/main.go', 'Run', 'Server', 'method', 7, 9), ('srv/main.go', 'listen_on', None, 'function', 11, 12)]

CALLS = [('app/Player.kt:Player.play', 'app/Engine.java:Engine.start'), ('app/Player.kt:Player.play', 'app/Player.kt:Player.helper'), ('app/Engine.java:Engine.start', 'app/Engine.java:Engine.prepare'),
    ('lib/a.py:chain_one', 'lib/b.py:chain_two'), ('lib/a.py:Box.open', 'lib/a.py:Box.fill'), ('lib/a.py:Box.fill', 'lib/a.py:chain_one'), ('web/view.ts:View.render', 'web/view.ts:draw'),
    ('core/sound.rs:Sound.rate_of', 'core/sound.rs:compute_rate'), ('srv/main.go:Server.Run', 'srv/main.go:listen_on')]

MORE_SPANS = [('net/Room.cs', 'Room', None, 'class', 1, 11), ('net/Room.cs', 'Size', 'Room', 'method', 3, 3), ('net/Room.cs', 'Fill', 'Room', 'method', 8, 10),
    ('ui/page.dart', 'Page', None, 'class', 1, 5), ('ui/page.dart', 'build', 'Page', 'method', 2, 4), ('ui/page.dart', 'paintAll', None, 'function', 7, 8),
    ('ios/Feed.swift', 'Feed', None, 'class', 1, 10), ('ios/Feed.swift', 'load', 'Feed', 'method', 2, 7), ('ios/Feed.swift', 'refresh', 'Feed', 'method', 8, 9),
    ('jni/Base.cpp', 'Java_app_Base_nativeOpen', None, 'function', 1, 3)]
