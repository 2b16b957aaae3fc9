"""The Java kernel of suffix_dedup: anchors of a text, suffix sorting by Lyndon groups, and cutting."""

PACKAGE = "marlstone_suffix"

SOURCE = r"""
package marlstone_suffix;

import java.security.MessageDigest;
import java.util.ArrayList;
import java.util.Arrays;
import java.util.HashMap;
import java.util.HashSet;
import org.apache.spark.sql.Row;
import org.apache.spark.sql.RowFactory;
import org.apache.spark.sql.api.java.UDF1;
import org.apache.spark.sql.api.java.UDF2;
import org.apache.spark.sql.api.java.UDF3;
import org.apache.spark.sql.api.java.UDF4;
import org.apache.spark.sql.api.java.UDF5;

/** Runs of windows that share their least k-gram: {hash of the k-gram, hash of the run's bytes, first start, last start, start of the k-gram}. */
class Scan {
  static final long M = 0x9E3779B97F4A7C15L;

  static long mix(long x) {
    x = (x ^ (x >>> 30)) * 0xBF58476D1CE4E5B9L;
    x = (x ^ (x >>> 27)) * 0x94D049BB133111EBL;
    return x ^ (x >>> 31);
  }

  /** Hashes of the k-grams. */
  static long[] grams(byte[] t, int k) {
    long[] h = new long[t.length - k + 1];
    long power = 1, x = 0;
    for (int i = 0; i < k; i++) { x = x * M + (t[i] & 255) + 1; if (i > 0) power *= M; }
    h[0] = mix(x);
    for (int i = 1; i < h.length; i++) {
      x = (x - ((t[i - 1] & 255) + 1) * power) * M + (t[i + k - 1] & 255) + 1;
      h[i] = mix(x);
    }
    return h;
  }

  /** The distinct anchors in order, without the runs. */
  static long[] anchors(byte[] t, int window, int k) {
    if (t.length < window) return new long[0];
    long[] h = grams(t, k), out = new long[h.length];
    int wide = window - k + 1, least = -1, m = 0;
    for (int i = wide - 1; i < h.length; i++) {
      int at = least;
      if (least <= i - wide) {
        at = i - wide + 1;
        for (int j = at + 1; j <= i; j++) if (h[j] < h[at]) at = j;
      } else if (h[i] < h[least]) at = i;
      if (at != least) { out[m++] = h[at]; least = at; }
    }
    Arrays.sort(out, 0, m);
    int d = 0;
    for (int i = 0; i < m; i++) if (i == 0 || out[i] != out[i - 1]) out[d++] = out[i];
    return Arrays.copyOf(out, d);
  }

  static long[][] runs(byte[] t, int window, int k) {
    int n = t.length;
    if (n < window) return new long[0][];
    int grams = n - k + 1;
    long[] h = grams(t, k);
    long[] sum = new long[n + 1];
    for (int i = 0; i < n; i++) sum[i + 1] = sum[i] * M2 + BYTES[t[i] & 255];
    long[] powers = new long[2 * window + 1];
    powers[0] = 1;
    for (int i = 1; i < powers.length; i++) powers[i] = powers[i - 1] * M2;
    int wide = window - k + 1, starts = n - window + 1, head = 0, tail = 0, from = 0, least = -1;
    int[] queue = new int[grams + 1];
    ArrayList out = new ArrayList();
    for (int i = 0; i < grams; i++) {
      while (tail > head && h[queue[tail - 1]] > h[i]) tail--;
      queue[tail++] = i;
      int s = i - wide + 1;
      if (s < 0) continue;
      while (queue[head] < s) head++;
      if (queue[head] != least) {
        if (least >= 0) out.add(run(h, least, sum, powers, from, s - 1, window));
        least = queue[head];
        from = s;
      }
    }
    out.add(run(h, least, sum, powers, from, starts - 1, window));
    return (long[][]) out.toArray(new long[0][]);
  }

  /** Another multiplier and random values of the bytes, so that the run's hash tells nothing that the k-gram's tells. */
  static final long M2 = 0xD1B54A32D192ED03L;
  static final long[] BYTES = new long[256];
  static { for (int i = 0; i < 256; i++) BYTES[i] = mix((i + 1) * M2); }

  static long[] run(long[] h, int least, long[] sum, long[] powers, int first, int last, int window) {
    int end = last + window, n = end - first;
    return new long[] {h[least], mix(sum[end] - sum[first] * powers[n]) ^ n, first, last, least};
  }
}

/** The 128 bits that name the bytes of a run: hashes of its anchor and of all of it. */
class Name {
  final long h, c;
  Name(long h, long c) { this.h = h; this.c = c; }
  public boolean equals(Object o) { return o instanceof Name && ((Name) o).h == h && ((Name) o).c == c; }
  public int hashCode() { return (int) (c ^ (c >>> 32)); }
}

/** Suffix sorting by grouping: suffixes are grouped by their Lyndon prefix, groups from the greatest down; then each is put in its place. */
class Lyndon {
  /** t: symbols from 0 to sigma - 1; the last is the least and occurs once. */
  static int[] sort(int[] t, int sigma) {
    int n = t.length;
    int[] sa = new int[n], place = new int[n], group = new int[n], size = new int[n + 1], prev = new int[n];
    int[] first = new int[sigma + 1];
    for (int i = 0; i < n; i++) first[t[i] + 1]++;
    for (int c = 0; c < sigma; c++) first[c + 1] += first[c];
    int[] next = Arrays.copyOf(first, sigma);
    for (int i = 0; i < n; i++) {
      int p = next[t[i]]++;
      sa[p] = i; place[i] = p; group[i] = first[t[i]];
      size[group[i]]++;
    }
    Arrays.fill(prev, -2);
    int[] count = new int[n];
    int[] parents = new int[n], bucket = new int[n + 2], sorted = new int[n];
    int end = n;
    while (end > 0) {
      int start = group[sa[end - 1]], found = 0, most = 0;
      for (int a = start; a < end; a++) {
        int s = sa[a];
        if (prev[s] == -2) {
          int p = s - 1;
          while (p >= 0 && group[p] >= start) p = prev[p] != -2 ? prev[p] : p - 1;
          // members of this group on the way have the same pointer
          for (int q = s; q > p; ) {
            if (prev[q] == -2) prev[q--] = p;
            else q = prev[q];
          }
        }
        int p = prev[s];
        if (p >= 0) {
          if (count[p]++ == 0) parents[found++] = p;
          if (count[p] > most) most = count[p];
        }
      }
      // parents by how many members of the group they have, from many to few
      Arrays.fill(bucket, 0, most + 2, 0);
      for (int a = 0; a < found; a++) bucket[count[parents[a]]]++;
      int sum = 0;
      for (int c = most; c >= 1; c--) { int m = bucket[c]; bucket[c] = sum; sum += m; }
      for (int a = 0; a < found; a++) sorted[bucket[count[parents[a]]]++] = parents[a];
      int a = 0;
      while (a < found) {
        int b = a, c = count[sorted[a]];
        while (b < found && count[sorted[b]] == c) {
          int p = sorted[b++], g = group[p], last = g + --size[g], other = sa[last], at = place[p];
          sa[last] = p; place[p] = last; sa[at] = other; place[other] = at;
        }
        for (int i = a; i < b; i++) {
          int p = sorted[i], g = group[p];
          bucket[0] = g + size[g];
          group[p] = bucket[0];
        }
        for (int i = a; i < b; i++) size[group[sorted[i]]]++;
        a = b;
      }
      for (int i = 0; i < found; i++) count[parents[i]] = 0;
      end = start;
    }
    // every suffix goes to the next free place of its group once the suffix behind its Lyndon prefix is in place
    Arrays.fill(place, -1);
    int[] free = size;
    for (int i = 0; i <= n; i++) free[i] = i;
    sa[0] = n - 1;
    place[n - 1] = 0;
    for (int i = 0; i < n; i++) {
      int s = sa[i] - 1;
      while (s >= 0 && place[s] < 0) {
        int at = free[group[s]]++;
        sa[at] = s;
        place[s] = at;
        s = prev[s];
      }
    }
    return sa;
  }

  /** Common prefix of each suffix in order and the one before it. */
  static int[] common(int[] t, int[] sa) {
    int n = t.length, l = 0;
    int[] rank = new int[n], lcp = new int[n];
    for (int i = 0; i < n; i++) rank[sa[i]] = i;
    for (int i = 0; i < n; i++) {
      if (rank[i] == 0) { l = 0; continue; }
      int j = sa[rank[i] - 1];
      while (i + l < n && j + l < n && t[i + l] == t[j + l]) l++;
      lcp[rank[i]] = l;
      if (l > 0) l--;
    }
    return lcp;
  }
}

public class Kernel {
  static byte[] bytes(Object x) { return x == null ? new byte[0] : (byte[]) x; }

  static HashSet set(Object longs) {
    HashSet out = new HashSet();
    scala.collection.Iterator it = ((scala.collection.Seq) longs).iterator();
    while (it.hasNext()) out.add(it.next());
    return out;
  }
}

/** (text, window, k) -> distinct hashes of its anchors. */
public class Hashes implements UDF3 {
  public Object call(Object text, Object window, Object k) {
    long[] h = Scan.anchors(Kernel.bytes(text), ((Integer) window).intValue(), ((Integer) k).intValue());
    ArrayList out = new ArrayList(h.length);
    for (int i = 0; i < h.length; i++) out.add(Long.valueOf(h[i]));
    return out;
  }
}

/** (text, window, k, hashes, hashes of frequent anchors) -> the distinct runs of these anchors: h, c, frequent. */
public class Runs implements UDF5 {
  public Object call(Object text, Object window, Object k, Object hashes, Object frequent) {
    HashSet wanted = Kernel.set(hashes), often = Kernel.set(frequent), seen = new HashSet();
    long[][] runs = Scan.runs(Kernel.bytes(text), ((Integer) window).intValue(), ((Integer) k).intValue());
    ArrayList out = new ArrayList();
    for (int i = 0; i < runs.length; i++) {
      Long h = Long.valueOf(runs[i][0]);
      boolean hot = often.contains(h);
      if ((hot || wanted.contains(h)) && seen.add(new Name(runs[i][0], runs[i][1]))) out.add(RowFactory.create(new Object[] {h, Long.valueOf(runs[i][1]), Boolean.valueOf(hot)}));
    }
    return out;
  }
}

/** (text, window, k, rows of h, c, first and last document, single) -> contexts of these runs: h, c, first, last, place of the anchor, bytes, pieces.

 Runs whose anchor has one content only (single) are compared with nothing, so neighbours are one context of up to MOST bytes, with a piece each. Other contexts have no pieces: all their windows are of one run. */
public class Pick implements UDF4 {
  static final int MOST = 1 << 16;

  public Object call(Object text, Object windowValue, Object k, Object contents) {
    byte[] t = Kernel.bytes(text);
    int window = ((Integer) windowValue).intValue();
    HashMap wanted = new HashMap();
    scala.collection.Iterator it = ((scala.collection.Seq) contents).iterator();
    while (it.hasNext()) {
      Row r = (Row) it.next();
      wanted.put(new Name(r.getLong(0), r.getLong(1)), r);
    }
    long[][] runs = Scan.runs(t, window, ((Integer) k).intValue());
    Row[] own = new Row[runs.length];
    for (int i = 0; i < runs.length; i++) own[i] = (Row) wanted.remove(new Name(runs[i][0], runs[i][1]));
    ArrayList out = new ArrayList();
    int i = 0;
    while (i < runs.length) {
      if (own[i] == null) { i++; continue; }
      boolean single = own[i].getBoolean(4);
      int j = i + 1, from = (int) runs[i][2];
      if (single) while (j < runs.length && own[j] != null && own[j].getBoolean(4) && runs[j][3] - from < MOST) j++;
      ArrayList pieces = single ? new ArrayList() : null;
      for (int m = i; single && m < j; m++) pieces.add(RowFactory.create(new Object[] {own[m].get(0), own[m].get(1), own[m].get(2), own[m].get(3), Integer.valueOf((int) runs[m][2] - from), Integer.valueOf((int) runs[m][3] - from)}));
      out.add(RowFactory.create(new Object[] {own[i].get(0), own[i].get(1), own[i].get(2), own[i].get(3), Integer.valueOf(single ? -1 : (int) runs[i][4] - from), Arrays.copyOfRange(t, from, (int) runs[j - 1][3] + window), pieces}));
      i = j;
    }
    return out;
  }
}

/** (bytes) -> order of its suffixes, for tests. */
public class Order implements UDF1 {
  public Object call(Object text) {
    byte[] b = Kernel.bytes(text);
    int[] t = new int[b.length + 1];
    for (int i = 0; i < b.length; i++) t[i] = (b[i] & 255) + 1;
    int[] sa = Lyndon.sort(t, 257);
    ArrayList out = new ArrayList();
    for (int i = 1; i < sa.length; i++) out.add(Integer.valueOf(sa[i]));
    return out;
  }
}

/** (contexts: h, c, first and last document, bytes, pieces of h, c, first and last document, first and last start; window) -> h, c, first and last start inside a piece, and the least document of these windows, where the piece has a later one. */
public class Earlier implements UDF2 {
  public Object call(Object contexts, Object windowValue) {
    scala.collection.Seq all = (scala.collection.Seq) contexts;
    int window = ((Integer) windowValue).intValue(), m = all.length(), n = 1, p = 0;
    byte[][] parts = new byte[m][];
    for (int i = 0; i < m; i++) {
      Row r = (Row) all.apply(i);
      parts[i] = (byte[]) r.get(4);
      n += parts[i].length + 1;
      p += r.isNullAt(5) ? 1 : ((scala.collection.Seq) r.get(5)).length();
    }
    long[] h = new long[p], c = new long[p], first = new long[p], last = new long[p];
    int[] begin = new int[p], piece = new int[n];
    Arrays.fill(piece, -1);
    for (int i = 0, k = 0, from = 0; i < m; i++) {
      Row own = (Row) all.apply(i);
      scala.collection.Iterator it = own.isNullAt(5) ? null : ((scala.collection.Seq) own.get(5)).iterator();
      do {
        Row r = it == null ? own : (Row) it.next();
        h[k] = r.getLong(0); c[k] = r.getLong(1); first[k] = r.getLong(2); last[k] = r.getLong(3);
        begin[k] = it == null ? from : from + r.getInt(4);
        Arrays.fill(piece, begin[k], it == null ? from + parts[i].length - window + 1 : from + r.getInt(5) + 1, k);
        k++;
      } while (it != null && it.hasNext());
      from += parts[i].length + 1;
    }
    // 0 ends everything, 1 ends a context; a match never counts beyond the end of its context
    int[] t = new int[n];
    int at = 0;
    for (int i = 0; i < m; i++) {
      for (int j = 0; j < parts[i].length; j++) t[at++] = (parts[i][j] & 255) + 2;
      t[at++] = 1;
    }
    int[] sa = Lyndon.sort(t, 258), lcp = Lyndon.common(t, sa);
    long[] low = new long[n];
    int a = 0;
    while (a < n) {
      int b = a + 1;
      while (b < n && lcp[b] >= window) b++;
      long least = Long.MAX_VALUE;
      for (int i = a; i < b; i++) if (piece[sa[i]] >= 0 && first[piece[sa[i]]] < least) least = first[piece[sa[i]]];
      for (int i = a; i < b; i++) low[sa[i]] = least;
      a = b;
    }
    ArrayList out = new ArrayList();
    int i = 0;
    while (i < n) {
      int k = piece[i];
      if (k < 0 || last[k] <= low[i]) { i++; continue; }
      int j = i;
      while (piece[j + 1] == k && low[j + 1] == low[i]) j++;
      out.add(RowFactory.create(new Object[] {Long.valueOf(h[k]), Long.valueOf(c[k]), Integer.valueOf(i - begin[k]), Integer.valueOf(j - begin[k]), Long.valueOf(low[i])}));
      i = j + 1;
    }
    return out;
  }
}

/** (text, h, c with first and last start inside their run, window, k) -> bytes, removed bytes, spans as start, end, ..., SHA-256 of the rest. */
public class Cut implements UDF4 {
  public Object call(Object text, Object ranges, Object windowValue, Object k) throws Exception {
    byte[] t = Kernel.bytes(text);
    int window = ((Integer) windowValue).intValue(), n = t.length;
    int[] edge = new int[n + 1];
    if (ranges != null) {
      HashMap told = new HashMap();
      scala.collection.Iterator it = ((scala.collection.Seq) ranges).iterator();
      while (it.hasNext()) {
        Row r = (Row) it.next();
        Name name = new Name(r.getLong(0), r.getLong(1));
        ArrayList own = (ArrayList) told.get(name);
        if (own == null) { own = new ArrayList(); told.put(name, own); }
        own.add(r);
      }
      long[][] runs = Scan.runs(t, window, ((Integer) k).intValue());
      for (int i = 0; i < runs.length; i++) {
        ArrayList own = (ArrayList) told.get(new Name(runs[i][0], runs[i][1]));
        if (own == null) continue;
        int first = (int) runs[i][2];
        for (int j = 0; j < own.size(); j++) {
          Row r = (Row) own.get(j);
          edge[first + r.getInt(2)]++;
          edge[first + r.getInt(3) + window]--;
        }
      }
    }
    MessageDigest digest = MessageDigest.getInstance("SHA-256");
    ArrayList spans = new ArrayList();
    int depth = 0, from = 0, removed = 0;
    boolean in = false;
    for (int i = 0; i <= n; i++) {
      depth += edge[i];
      boolean hit = i < n && depth > 0;
      if (hit != in || i == n) {
        if (in) { removed += i - from; spans.add(Integer.valueOf(from)); spans.add(Integer.valueOf(i)); }
        else digest.update(t, from, i - from);
        from = i;
        in = hit;
      }
    }
    byte[] d = digest.digest();
    StringBuilder hex = new StringBuilder();
    for (int i = 0; i < d.length; i++) { hex.append(Character.forDigit((d[i] >> 4) & 15, 16)); hex.append(Character.forDigit(d[i] & 15, 16)); }
    return RowFactory.create(new Object[] {Long.valueOf(n), Long.valueOf(removed), spans, hex.toString()});
  }
}
"""
