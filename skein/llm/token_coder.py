"""A block coder of token ids: adaptive context mixing of order-0 to order-2 predictions, and a range coder.

For each id, order 2 (the two ids before it) names the id that it saw last; if it has one, "is it that id?" is a binary decision with an adaptive chance for each
confidence and recent history. An id that order 2 does not foretell is spelled in nibbles from the highest down. For each nibble, order 0 and order 1
(the id before) hold adaptive distributions, the one by the nibbles before it, the other by these and the id before. The two are mixed by a weight that is learned for each nibble's place and for each number of
times that order 1 has been here, after how well either foretold what came. All arithmetic is on integers, so any machine decodes what another one wrote.

The same coder is there twice. The one in Java is compiled by the compiler that Spark itself generates code with, shipped to the executors as a jar and called as a function of a column of
packed ids. The one in Python is its plain statement, some hundred times slower, and reads single blocks. Both write the same bytes.
"""

from __future__ import annotations

import struct
import uuid
import zipfile
import zlib
from io import BytesIO

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from skein.llm.store import shared_dir

#: Ids of a block, which starts from an empty state.
BLOCK = 1 << 16
#: Ids must be below this.
LIMIT = 1 << 20
#: Bits of the tables of order 1 and order 2.
SLOTS1, SLOTS2 = 16, 16

#: Packed ids to a body and back: blocks one after the other, each with its length and the CRC-32 of its ids, little-endian, before it.
SOURCE = """
package skein;

public class TokenCoder implements org.apache.spark.sql.api.java.UDF2, java.io.Serializable {
  static final int BLOCK = 65536, S1 = 16, S2 = 16, ROOT = 1 + 16 + 256 + 4096, TOP = 1 << 24;
  static final int[] RATE = {1, 2, 2, 3, 3, 4, 4, 4, 5, 5, 5, 5, 5, 5, 5, 5};
  private static final ThreadLocal KEPT = new ThreadLocal();
  private final boolean decode;

  public TokenCoder(boolean decode) { this.decode = decode; }

  public Object call(Object data, Object nibbles) {
    if (data == null) return null;
    int k = ((Integer) nibbles).intValue();
    Work w = (Work) KEPT.get();
    if (w == null || w.nibbles != k) { w = new Work(k); KEPT.set(w); }
    return decode ? w.decode((byte[]) data) : w.encode((byte[]) data);
  }

  static class Work {
    final int nibbles;
    final char[] t0, t1 = new char[16 << S1], fresh0, fresh1;
    final int[] t2 = new int[1 << S2];
    final int[] flag = new int[16 * 8], weight = new int[5 * 8], mid = new int[17];
    long low;
    int range, code, cache;
    long pending;
    byte[] bytes;
    int at, end;

    Work(int nibbles) {
      this.nibbles = nibbles;
      t0 = new char[16 * (nibbles < 5 ? ROOT : ROOT + 65536)];
      fresh0 = new char[t0.length];
      fresh1 = new char[t1.length];
      for (int i = 0; i < fresh0.length; i++) fresh0[i] = (char) ((i & 15) << 11);
      for (int i = 0; i < fresh1.length; i++) fresh1[i] = (char) ((i & 15) << 11);
      mid[16] = 32768;
    }

    void reset() {
      System.arraycopy(fresh0, 0, t0, 0, t0.length);
      System.arraycopy(fresh1, 0, t1, 0, t1.length);
      java.util.Arrays.fill(t2, 0);
      java.util.Arrays.fill(flag, 1 << 14);
      for (int i = 0; i < 5; i++) for (int j = 0; j < 8; j++) weight[i * 8 + j] = j == 0 ? 1 << 12 : 1 << 14;
    }

    void push(int b) {
      if (at == bytes.length) bytes = java.util.Arrays.copyOf(bytes, bytes.length * 2);
      bytes[at++] = (byte) b;
    }

    void shift() {
      if (low < 0xFF000000L || low > 0xFFFFFFFFL) {
        int carry = (int) (low >>> 32), c = cache;
        while (pending > 0) { push(c + carry); c = 0xFF; pending--; }
        cache = (int) (low >>> 24) & 255;
      }
      pending++;
      low = (low & 0x00FFFFFFL) << 8;
    }

    void put(int begin, int size) {
      int u = range >>> 15;
      low += (u & 0xFFFFFFFFL) * begin;
      range = u * size;
      while (range >>> 24 == 0) { range <<= 8; shift(); }
    }

    int next() { return at < end ? bytes[at++] & 255 : 0; }

    int point() {
      int v = Integer.divideUnsigned(code, range >>> 15);
      return v >= 0 && v < 32767 ? v : 32767;
    }

    void took(int begin, int size) {
      int u = range >>> 15;
      code -= u * begin;
      range = u * size;
      while (range >>> 24 == 0) { range <<= 8; code = code << 8 | next(); }
    }

    static int hash(int a, int b) {
      int h = (a * 0x9E3779B1) ^ ((b + 0x7F4A7C15) * 0x85EBCA6B);
      h ^= h >>> 15;
      h *= 0xC2B2AE35;
      return h ^ h >>> 13;
    }

    static int top(char[] c, int o, int i) { if (i == 0) return 0; if (i == 16) return 32768; return c[o + i]; }

    static void learn(char[] c, int o, int s) {
      int n = c[o], rate = RATE[n];
      for (int i = 1; i <= s; i++) c[o + i] = (char) (c[o + i] + (i - c[o + i] >> rate));
      for (int i = s + 1; i < 16; i++) c[o + i] = (char) (c[o + i] + (i + 32752 - c[o + i] >> rate));
      if (n < 15) c[o] = (char) (n + 1);
    }

    int nibble(int place, int a, int b, int s, boolean decode) {
      char[] t0 = this.t0, t1 = this.t1;
      int[] mid = this.mid;
      int seen = Math.min((int) t1[b], 7), at = place * 8 + seen, wb = weight[at], wa = 32768 - wb;
      for (int i = 1; i < 16; i++) mid[i] = wa * t0[a + i] + wb * t1[b + i] >>> 15;
      if (decode) {
        int v = point();
        s = 0;
        if (v >= mid[8]) s = 8;
        if (v >= mid[s + 4]) s += 4;
        if (v >= mid[s + 2]) s += 2;
        if (v >= mid[s + 1]) s += 1;
        took(mid[s], mid[s + 1] - mid[s]);
      } else put(mid[s], mid[s + 1] - mid[s]);
      int pa = top(t0, a, s + 1) - top(t0, a, s), pb = top(t1, b, s + 1) - top(t1, b, s);
      int step = (int) ((long) (wa * wb >>> 15) * (pb - pa) / (mid[s + 1] - mid[s]));
      int to = wb + (step >> 4);
      weight[at] = to < 256 ? 256 : to > 32512 ? 32512 : to;
      learn(t0, a, s);
      learn(t1, b, s);
      return s;
    }

    void run(int[] ids, int from, int n, boolean decode) {
      int p1 = 0x100001, p2 = 0x100002, past = 0;
      reset();
      for (int t = from; t < from + n; t++) {
        int e = hash(p2, p1) >>> 32 - S2, entry = t2[e], guess = entry >>> 4, sure = entry & 15, id = ids[t];
        boolean hit = false;
        if (sure > 0) {
          int f = sure * 8 + past, p = flag[f];
          if (decode) { hit = point() < p; took(hit ? 0 : p, hit ? p : 32768 - p); }
          else { hit = id == guess; put(hit ? 0 : p, hit ? p : 32768 - p); }
          flag[f] = hit ? p + (32704 - p >> 5) : p - (p - 64 >> 5);
          past = (past << 1 | (hit ? 1 : 0)) & 7;
        }
        if (hit) { id = guess; t2[e] = guess << 4 | (sure < 15 ? sure + 1 : 15); }
        else {
          int v = 0, first = 0;
          for (int k = 0; k < nibbles; k++) {
            int s = nibble(k, first + v << 4, hash(p1, first + v) >>> 32 - S1 << 4, id >>> 4 * (nibbles - 1 - k) & 15, decode);
            v = v << 4 | s;
            first += 1 << 4 * k;
          }
          id = v;
          t2[e] = sure > 1 ? guess << 4 | sure >> 1 : id << 4 | 1;
        }
        ids[t] = id;
        p2 = p1;
        p1 = id;
      }
    }

    static int crc(byte[] packed, int from, int to) {
      java.util.zip.CRC32 c = new java.util.zip.CRC32();
      c.update(packed, from, to - from);
      return (int) c.getValue();
    }

    byte[] encode(byte[] packed) {
      java.nio.ByteBuffer in = java.nio.ByteBuffer.wrap(packed).order(java.nio.ByteOrder.LITTLE_ENDIAN);
      int n = packed.length / 4;
      int[] ids = new int[n];
      in.asIntBuffer().get(ids);
      bytes = new byte[n * 2 + 64];
      at = 0;
      for (int k = 0; k < n; k += BLOCK) {
        int size = Math.min(BLOCK, n - k), head = at;
        for (int i = 0; i < 8; i++) push(0);
        low = 0; range = -1; cache = 0; pending = 1;
        run(ids, k, size, false);
        for (int i = 0; i < 5; i++) shift();
        java.nio.ByteBuffer.wrap(bytes).order(java.nio.ByteOrder.LITTLE_ENDIAN).putInt(head, at - head - 8).putInt(head + 4, crc(packed, 4 * k, 4 * (k + size)));
      }
      byte[] out = java.util.Arrays.copyOf(bytes, at);
      bytes = null;
      return out;
    }

    byte[] decode(byte[] body) {
      java.nio.ByteBuffer in = java.nio.ByteBuffer.wrap(body).order(java.nio.ByteOrder.LITTLE_ENDIAN);
      if (body.length < 4) throw new IllegalArgumentException("frame cut short");
      int n = in.getInt(0), place = 4;
      byte[] out = new byte[4 * n];
      java.nio.ByteBuffer to = java.nio.ByteBuffer.wrap(out).order(java.nio.ByteOrder.LITTLE_ENDIAN);
      int[] ids = new int[Math.min(n, BLOCK)];
      bytes = body;
      for (int k = 0; k < n; k += BLOCK) {
        if (place + 8 > body.length) throw new IllegalArgumentException("frame cut short");
        int size = Math.min(BLOCK, n - k), length = in.getInt(place), sum = in.getInt(place + 4);
        at = place + 8;
        if (length < 0 || length > body.length - at) throw new IllegalArgumentException("frame cut short");
        end = at + length;
        place = end;
        range = -1; code = 0;
        for (int i = 0; i < 5; i++) code = code << 8 | next();
        run(ids, 0, size, true);
        for (int i = 0; i < size; i++) to.putInt(4 * (k + i), ids[i]);
        if (crc(out, 4 * k, 4 * (k + size)) != sum) throw new IllegalArgumentException("damaged block " + k / BLOCK);
      }
      bytes = null;
      return out;
    }
  }
}
"""

_M32 = (1 << 32) - 1
_RATE = (1, 2, 2, 3, 3, 4, 4, 4, 5, 5, 5, 5, 5, 5, 5, 5)


_ready: dict[str, tuple[str, object]] = {}  # by application: name of the functions, and the class behind them


def _functions(spark: SparkSession) -> str:
    """Name of the two functions (with _encode, _decode after it). The class is compiled and shipped once an application, the functions are registered once a session."""
    app, jvm = spark.sparkContext.applicationId, spark.sparkContext._jvm
    if app not in _ready:
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
        compiler.cook(SOURCE)
        packed = BytesIO()
        with zipfile.ZipFile(packed, "w") as z:
            for name, code in dict(compiler.getBytecodes()).items():
                z.writestr(name.replace(".", "/") + ".class", bytes(code))
        name = f"skein_{uuid.uuid4().hex[:12]}"
        path = f"{shared_dir(spark)}/{name}.jar"
        at = jvm.org.apache.hadoop.fs.Path(path)
        out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
        out.write(packed.getvalue())
        out.close()
        spark.sparkContext._jsc.addJar(path)
        _ready[app] = name, compiler.getClassLoader().loadClass("skein.TokenCoder").getConstructors()[0]
    name, kind = _ready[app]
    if not spark.catalog.functionExists(f"{name}_decode"):
        for suffix, decode in (("encode", False), ("decode", True)):
            args = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 1)
            args[0] = decode
            spark._jsparkSession.udf().register(f"{name}_{suffix}", kind.newInstance(args), jvm.org.apache.spark.sql.types.DataTypes.BinaryType)
    return name


def encoded(spark: SparkSession, ids: Column, nibbles: Column) -> Column:
    """A column of packed ids (little-endian 32-bit) as a body of blocks."""
    return F.call_function(f"{_functions(spark)}_encode", ids, nibbles.cast("int"))


def decoded(spark: SparkSession, n: Column, body: Column, nibbles: Column) -> Column:
    """The packed ids of a body of n ids; a damaged block fails the query."""
    head = F.unhex(F.regexp_replace(F.lpad(F.hex(n), 8, "0"), "(..)(..)(..)(..)", "$4$3$2$1"))
    return F.call_function(f"{_functions(spark)}_decode", F.concat(head, body), nibbles.cast("int"))


def nibbles_of(ids: np.ndarray) -> int:
    """Nibbles that the greatest id takes, four at least. ValueError for ids that are not in 0 .. LIMIT - 1."""
    if len(ids) and (int(ids.min()) < 0 or int(ids.max()) >= LIMIT):
        raise ValueError(f"ids must be from 0 to {LIMIT - 1}")
    return 5 if len(ids) and int(ids.max()) >> 16 else 4


def encode_body(ids: np.ndarray, nibbles: int) -> bytes:
    """The body of a sequence of ids, by the plain coder."""
    out = []
    for k in range(0, len(ids), BLOCK):
        some = np.ascontiguousarray(ids[k : k + BLOCK], "<u4")
        block = _encode_slowly(some.tolist(), nibbles)
        out.append(struct.pack("<II", len(block), zlib.crc32(some.tobytes())) + block)
    return b"".join(out)


def decode_body(body: bytes, n: int, nibbles: int, block: int | None = None) -> np.ndarray:
    """The ids of a body, or of one block alone, by the plain coder. ValueError if a block is not as it was written."""
    out, at = [], 0
    for k in range(0, n, BLOCK):
        if at + 8 > len(body):
            raise ValueError("frame cut short")
        size, crc = struct.unpack_from("<II", body, at)
        at += 8 + size
        if at > len(body):
            raise ValueError("frame cut short")
        if block in (None, k // BLOCK):
            ids = np.array(_decode_slowly(body[at - size : at], min(BLOCK, n - k), nibbles), "<u4")
            if zlib.crc32(ids.tobytes()) != crc:
                raise ValueError(f"damaged block {k // BLOCK}")
            out.append(ids)
    return np.concatenate(out) if out else np.zeros(0, "<u4")


class _Encoder:
    decode = False

    def __init__(self) -> None:
        self.low, self.range, self.cache, self.pending, self.out = 0, _M32, 0, 1, bytearray()

    def shift(self) -> None:
        if self.low < 0xFF000000 or self.low > _M32:
            carry, c = self.low >> 32, self.cache
            while self.pending:
                self.out.append((c + carry) & 255)
                c = 0xFF
                self.pending -= 1
            self.cache = self.low >> 24 & 255
        self.pending += 1
        self.low = (self.low & 0x00FFFFFF) << 8

    def take(self, begin: int, size: int) -> None:
        u = self.range >> 15
        self.low += u * begin
        self.range = u * size
        while self.range < 1 << 24:
            self.range = self.range << 8 & _M32
            self.shift()


class _Decoder:
    decode = True

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.range, self.code = data, 0, _M32, 0
        for _ in range(5):
            self.code = (self.code << 8 | self.next()) & _M32

    def next(self) -> int:
        self.at += 1
        return self.data[self.at - 1] if self.at <= len(self.data) else 0

    def point(self) -> int:
        return min(self.code // (self.range >> 15), 32767)

    def take(self, begin: int, size: int) -> None:
        u = self.range >> 15
        self.code = (self.code - u * begin) & _M32
        self.range = u * size & _M32
        while self.range < 1 << 24:
            self.range = self.range << 8 & _M32
            self.code = (self.code << 8 | self.next()) & _M32


def _hash(a: int, b: int) -> int:
    h = (a * 0x9E3779B1 & _M32) ^ ((b + 0x7F4A7C15 & _M32) * 0x85EBCA6B & _M32)
    h = (h ^ h >> 15) * 0xC2B2AE35 & _M32
    return h ^ h >> 13


def _learn(c: list[int], s: int) -> None:
    rate = _RATE[c[0]]
    for i in range(1, 16):
        c[i] += (i if i <= s else i + 32768 - 16) - c[i] >> rate
    c[0] = min(c[0] + 1, 15)


def _slowly(coder: _Encoder | _Decoder, ids: list[int] | None, n: int, nibbles: int) -> list[int]:
    fresh = [i << 11 for i in range(16)]
    t0: dict[int, list[int]] = {}
    t1: dict[int, list[int]] = {}
    t2: dict[int, tuple[int, int]] = {}
    flags = [[1 << 14] * 8 for _ in range(16)]
    weights = [[1 << 14 if j else 1 << 12 for j in range(8)] for _ in range(5)]
    p1, p2, past, out = 0x100001, 0x100002, 0, []
    for t in range(n):
        at = _hash(p2, p1) >> 32 - SLOTS2
        guess, sure = t2.get(at, (0, 0))
        want = None if ids is None else ids[t]
        hit = False
        if sure:
            p = flags[sure][past]
            hit = coder.point() < p if want is None else want == guess
            coder.take(0 if hit else p, p if hit else 32768 - p)
            flags[sure][past] = p + (32768 - 64 - p >> 5) if hit else p - (p - 64 >> 5)
            past = (past << 1 | hit) & 7
        if hit:
            got, t2[at] = guess, (guess, min(sure + 1, 15))
        else:
            got, first = 0, 0
            for k in range(nibbles):
                a, b = t0.setdefault(first + got, fresh[:]), t1.setdefault(_hash(p1, first + got) >> 32 - SLOTS1, fresh[:])
                seen = min(b[0], 7)
                wb = weights[k][seen]
                wa = 32768 - wb
                mid = [0, *[wa * a[i] + wb * b[i] >> 15 for i in range(1, 16)], 32768]
                if want is None:
                    v = coder.point()
                    s = sum(v >= mid[i] for i in range(1, 16))
                else:
                    s = want >> 4 * (nibbles - 1 - k) & 15
                both = mid[s + 1] - mid[s]
                coder.take(mid[s], both)
                low = lambda c, i: 0 if i == 0 else 32768 if i == 16 else c[i]
                gain = (wa * wb >> 15) * ((low(b, s + 1) - low(b, s)) - (low(a, s + 1) - low(a, s)))
                step = abs(gain) // both * (1 if gain >= 0 else -1)
                weights[k][seen] = max(256, min(32768 - 256, wb + (step >> 4)))
                _learn(a, s)
                _learn(b, s)
                got, first = got << 4 | s, first + (1 << 4 * k)
            t2[at] = (guess, sure >> 1) if sure > 1 else (got, 1)
        out.append(got)
        p2, p1 = p1, got
    return out


def _encode_slowly(ids: list[int], nibbles: int) -> bytes:
    coder = _Encoder()
    _slowly(coder, ids, len(ids), nibbles)
    for _ in range(5):
        coder.shift()
    return bytes(coder.out)


def _decode_slowly(data: bytes, n: int, nibbles: int) -> list[int]:
    return _slowly(_Decoder(data), None, n, nibbles)
