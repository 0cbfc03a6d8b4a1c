"""One page for a browser: queries in both languages, a chart, and live results."""

PAGE = """<!doctype html>
<html lang="en"><head><meta charset="utf-8"><title>tidemark</title>
<style>
 body{font:14px system-ui;margin:2em auto;max-width:70em;padding:0 1em;color:#223}
 textarea{width:100%;height:4em;font:13px monospace;box-sizing:border-box}
 table{border-collapse:collapse;margin-top:1em}td,th{border:1px solid #ccd;padding:.2em .6em;text-align:right}
 svg{width:100%;height:16em;border:1px solid #ccd;margin-top:1em;background:#fafbff}
 #error{color:#a02}.row{display:flex;gap:.6em;align-items:center;margin:.5em 0}
</style></head><body>
<h1>tidemark</h1><p id="status"></p>
<textarea id="text">SELECT mean(value) FROM m GROUP BY time(5m)</textarea>
<div class="row"><button id="run">Run</button><label><input type="checkbox" id="live"> live, every</label>
<input id="every" type="number" value="1000" min="100" step="100" style="width:6em"> ms <span>(live: array language)</span><span id="took"></span></div>
<p id="error"></p><svg id="chart" viewBox="0 0 1000 300" preserveAspectRatio="none"></svg><div id="out"></div>
<script>
const $ = id => document.getElementById(id);
const post = (path, q) => fetch(path, {method: 'POST', body: JSON.stringify({q})}).then(r => r.json());
function cells(rows, names) {
  const t = document.createElement('table'), row = (tag, vs) => { const r = t.insertRow(); for (const v of vs) { const c = document.createElement(tag); c.textContent = v === null ? '' : v; r.append(c); } };
  row('th', names); rows.slice(0, 200).forEach(r => row('td', r)); $('out').replaceChildren(t);
}
function chart(xs, ys) {
  const p = xs.map((x, i) => [x, ys[i]]).filter(([x, y]) => typeof x === 'number' && typeof y === 'number');
  $('chart').replaceChildren(); if (p.length < 2) return;
  const at = (i, size) => { const v = p.map(q => q[i]), lo = Math.min(...v), hi = Math.max(...v); return q => (q[i] - lo) / (hi - lo || 1) * size; };
  const x = at(0, 980), y = at(1, 280), line = document.createElementNS('http://www.w3.org/2000/svg', 'polyline');
  line.setAttribute('points', p.map(q => `${10 + x(q)},${290 - y(q)}`).join(' ')); line.setAttribute('fill', 'none'); line.setAttribute('stroke', '#3457d5'); line.setAttribute('stroke-width', '2');
  line.setAttribute('vector-effect', 'non-scaling-stroke'); $('chart').append(line);
}
function show(r) {
  $('error').textContent = r.error || ''; if (r.error) return;
  if (r.elapsed_ns) $('took').textContent = (r.elapsed_ns / 1e6).toFixed(0) + ' ms';
  if (r.results) { const s = r.results[0].series[0]; cells(s.values, s.columns); const k = s.columns.findIndex((c, i) => i && s.values.some(v => typeof v[i] === 'number')); if (k > 0) chart(s.values.map((v, i) => v[0] ?? i), s.values.map(v => v[k])); }
  else if (r.type === 'table') { const n = r.columns, rows = r.data[n[0]].map((_, i) => n.map(c => r.data[c][i])); cells(rows, n); if (n.length > 1) chart(r.data[n[0]], r.data[n[1]]); }
  else if (r.values) { cells(r.values.map((v, i) => [i, v]), ['', r.type]); chart(r.values.map((_, i) => i), r.values); }
  else cells(Object.entries(r.data || {[r.type]: r.value}).map(([k, v]) => [k, JSON.stringify(v)]), ['', '']);
}
$('run').onclick = async () => { const q = $('text').value.trim(); show(await post(/^select\\s.+\\sfrom\\s/i.test(q) && /[A-Z]/.test(q.slice(0, 6)) ? '/query' : '/lang', q)); };
let ws = null;
$('live').onchange = () => {
  if (ws) { ws.close(); ws = null; }
  if (!$('live').checked) return;
  ws = new WebSocket(`ws://${location.host}/ws`);
  ws.onopen = () => ws.send(JSON.stringify({action: 'subscribe', id: 'page', query: $('text').value.trim(), interval_ms: +$('every').value}));
  ws.onmessage = e => { const m = JSON.parse(e.data); show(m.error ? m : m.data); };
};
fetch('/measurements').then(r => r.json()).then(r => { $('status').textContent = 'Measurements: ' + (r.measurements.join(', ') || 'none'); });
</script></body></html>
"""
